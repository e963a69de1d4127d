"""URL decoding and normalisation as JVM-side column expressions (no Python UDF)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsdeck.constants import DIGIT_RULE, JOURNEY_RULE, PREFIX_RULE_TEMPLATE

Rule = tuple[str, str]


def default_url_rules(id_prefix: str) -> list[Rule]:
    """The three rewrite rules of the log report; ``id_prefix`` names the site's reference codes."""
    pattern, replacement = PREFIX_RULE_TEMPLATE
    return [JOURNEY_RULE, DIGIT_RULE, (pattern.format(prefix=re.escape(id_prefix)), replacement)]


def lenient_url_decode(url: Column) -> Column:
    """Percent-decode like a lenient decoder: ``+`` stays ``+``, malformed escapes stay as
    written, invalid UTF-8 bytes become U+FFFD (one per maximal invalid subsequence).

    The built-in decoder turns ``+`` into a space and fails on a malformed escape, so both are
    neutralised first: a ``%`` not followed by two hex digits becomes ``%25`` and ``+`` becomes
    ``%2B``; both then decode back to themselves.
    """
    escaped = F.regexp_replace(url, r"%(?![0-9A-Fa-f]{2})", "%25")
    # An encoded UTF-16 surrogate (ED A0..BF ..) is invalid UTF-8 byte by byte; the JVM decoder
    # would fold it into one U+FFFD. Making the lead byte invalid on its own (FF) gives one
    # U+FFFD per byte, as byte-wise replacement does.
    escaped = F.regexp_replace(escaped, r"(?i)%ED(?=%[AB][0-9A-F])", "%FF")
    decoded = F.url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))
    # Without a '%' the text decodes to itself: skip the regex and the decoder for those rows.
    return F.when(url.contains("%"), decoded).otherwise(url)


def literal_replacement(text: str) -> str:
    """Quote ``\\`` and ``$`` so a replacement string is taken literally by ``regexp_replace``."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def normalize_url(url: Column, rules: Sequence[Rule]) -> Column:
    """Apply ordered (pattern, replacement) rewrites; each rule replaces every match.

    Patterns get the ``(?d)`` flag so ``.`` stops only at ``\\n`` (script-style line semantics);
    replacements are literal text.
    """
    for pattern, replacement in rules:
        url = F.regexp_replace(url, F.lit("(?d)" + pattern), F.lit(literal_replacement(replacement)))
    return url
