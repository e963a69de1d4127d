"""Fixed values. These must equal the original scripts' values for equal results.

Listed plainly, in the order the scripts use them. Everything site-specific (host names,
domains, mail addresses, process markers) is a parameter with a neutral default instead.
"""

# --- access-log statistics -------------------------------------------------------------
# Number of endpoints in the report.
DEFAULT_TOP_N = 50
# Log files read from a folder: plain files directly inside it ending in these suffixes.
LOG_FILE_GLOB = "*.{log,tsv}"
# One pattern for all five fields: Tt timer, status, bytes read, then method and URL.
LOG_PATTERN = r'\/(\d+)\s(\d+)\s+(\d+)\s+-.*?"(GET|POST|PUT|DELETE|PATCH|HEAD) ([^ ]+)'
# Status classes counted besides the total.
STATUS_CLASSES = (("n_2xx", 200, 299), ("n_4xx", 400, 499), ("n_5xx", 500, 599))
# URL rewrite rules, applied in this order after percent-decoding. The third rule's
# prefix is site-specific and therefore a parameter (see functions.urls.default_url_rules).
JOURNEY_RULE = (r"/jp/journeys/[^/]+/calling-points", "/jp/journeys/[fare_id]/calling-points")
DIGIT_RULE = (r"/(\d+)", "/[id]")
PREFIX_RULE_TEMPLATE = (r"/{prefix}.{{0,10}}", "/[id]")

# --- fleet inventory -------------------------------------------------------------------
ROLE_TAG_VALUE = "test"
# Fleet listing (calendar-day age, strict thresholds).
FLEET_WARN_DAYS = 30
FLEET_DANGER_DAYS = 60
FLEET_EXCLUDED_BUILDS = ("buildandscan",)
# Running listing (elapsed-day age, inclusive thresholds, overdue emphasis).
RUNNING_WARN_DAYS = 7
RUNNING_DANGER_DAYS = 14
RUNNING_OVERDUE_DAYS = 30
RUNNING_EXPIRES_TEXT = "n/a"
# Digests.
AGE_DIGEST_MIN_DAYS = 2
EXPIRY_DIGEST_WITHIN_DAYS = 8
# Costs: price of one instance-day in pence.
DAY_PRICE_PENCE = 700
# Broker names are "<build>-rabbit-dev..."; the console host is derived from the id.
BROKER_NAME_SEPARATOR = "-rabbit-dev"
BROKER_CONSOLE_TEMPLATE = "https://{broker_id}.mq.{region}.on.aws"
DEFAULT_REGION = "eu-west-1"
PORTAINER_PORT = 9000
# Calendar names used in rendered dates (English, as printed by the scripts).
WEEKDAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December")
# Plan actions.
ACTION_TERMINATE = "terminate"
ACTION_STOP = "stop"
ACTION_START = "start"

# --- rendered texts ----------------------------------------------------------------------
AGE_TODAY = "Today"
AGE_AGO_SUFFIX = " ago"
UNKNOWN_OWNER = "Unknown"
NOT_AVAILABLE = "n/a"
AGE_DIGEST_ITEM_FORMAT = "%s, running for %s"
EXPIRY_DIGEST_ITEM_FORMAT = "%s, created %s ago will be terminated on the evening of %s."
AGE_ZERO_TEXT = "less than a day"
DIGEST_SUBJECT_LEAD = "You have "
AGE_DIGEST_HEADING_FORMAT = "Here's a list of your instances that have been running for %s or more:"
EXPIRY_DIGEST_HEADING = "Here's a list of instances you launched that will be terminated soon:"
BOX_ITEM_FORMAT = "_*%s*_: %dd, £%d"
USER_ITEM_FORMAT = "_*%s*_: x%d, %dd"
TOTALS_FORMAT = "*%d* instances (*£%d/day*)\n*%d* cumulative days (*£%d*)"
ITEM_SEPARATOR = " | "
LINK_FORMAT = "<%s|%s>"
MESSAGE_LINK_TEXTS = ("create", "terminate", "full listing")
BY_AGE_TITLE = "= By age (oldest first) ="
BY_OWNER_TITLE = "= By dev ="
# Digest bodies (HTML): what opens a body (around the heading), each item, and what closes it.
AGE_BODY_OPEN = "<h3>EC2 instance report</h3><p>%s<p>\n"
AGE_BODY_ITEM = "<b>%s</b>, running for %s<br>\n"
AGE_BODY_CLOSE = "<p><a href='%s'>Manage your instances here</a>."
EXPIRY_BODY_OPEN = "<h3>EC2 instance termination warnings:</h3><p>%s<br><p>\n<ul>\n"
EXPIRY_BODY_ITEM = ("<li> <b>%s</b>, created %s ago will be terminated on the evening of %s."
                    " <a href='%s'>Extend instance life</a></li>\n")
# Fleet listing status marker: label and colour for running / not running.
STATUS_RUNNING = ("Running", "#28a745")
STATUS_STOPPED = ("Stopped", "#dc3545")
