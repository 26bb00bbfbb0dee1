"""Fixed values of the monitored data model, stated once.

Metric-name prefixes are parameters everywhere; the defaults below are neutral, pass
your collector's own prefixes to keep existing dashboards working.
"""

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# Width of the pieces a series is cut into: the rows one task sees of a hot series, and the number
# of pieces a window over the series sees, are both bounded by it.
CHUNK_US = 10 * MINUTE

STAT_PREFIX = "Fleet"
HEALTH_PREFIX = "FleetHealth"
TRANS_PREFIX = "FleetTrans"

# Mailbox ages.
MAIL_MIN_WAIT_US = 5 * MINUTE
MAIL_LOOKBACK_US = 72 * HOUR

# Server states.
STATE_AVAILABLE, STATE_RESTRICTED, STATE_BUSY, STATE_UNREACHABLE = 0, 1, 2, 3

# Maintenance states.
MAINT_NONE, MAINT_MANUAL, MAINT_WINDOW = 0, 1, 3

# Command words of maintenance, and the phrases of its report.
MAINT_OFF_WORDS = ("off", "clear")
MAINT_PREFIXES = ("on", "start +", "start ", "end +", "end ")
WILL_START, SINCE, WILL_END = "will start in ", "since ", "will end in "

# Business-time defaults.
DEFAULT_BUSINESS_DAYS = "1-5"
DEFAULT_BUSINESS_HOURS = "6-18"

# Disk components.
DISK_COMPONENTS = [
    "Notesdata", "Translog", "DAOS", "NIF", "FT", "NotesTemp", "ViewRebuild", "NotesLogDir",
]

# Built-in prefix rules on the lower-cased dotted statistic name.
DEFAULT_EXCLUDES = [
    "platform.",
    "disk.",
    "replica.cluster.currency.",
    "server.cluster.member.",
    "net.log.",
    "mem.pid.",
    "mem.local.max.used.",
    "traveler.",
]
DEFAULT_INCLUDES = [
    "platform.network.total.",
    "traveler.memory.",
    "traveler.status.state.severity",
    "traveler.push.",
    "traveler.primesync.count",
    "traveler.constrained.",
    "traveler.http.status.",
    "traveler.monitor.users",
]

# Retention and query limits.
METRIC_RETENTION_DAYS = 30
METRIC_RETENTION_BYTES = 200 * 1024**3
MAX_POINTS = 43200

# Fixed value: an alert nobody reports any more is over after this long.
RESOLVE_TIMEOUT_US = 5 * MINUTE
