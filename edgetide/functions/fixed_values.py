"""Fixed values.

Word lists, lookup tables, constants, patterns and formats that must have exactly
these values for results to be right. They are data, kept together here.
"""

# --- media types: extension -> media type (3 video, 4 image extensions) -------
MEDIA_TYPE_BY_EXTENSION = {
    "jpg": "image", "jpeg": "image", "png": "image", "gif": "image",
    "mp4": "video", "webm": "video", "mkv": "video",
}

# --- content classes: class -> extensions ------------------------------------
EXTENSIONS_BY_CLASS = {
    "video": ["mp4", "avi", "mkv", "mov", "wmv", "flv", "webm", "m4v"],
    "audio": ["mp3", "wav", "flac", "aac", "ogg", "m4a"],
    "image": ["jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "tiff"],
    "html": ["html", "htm", "php", "asp", "jsp"],
    "css": ["css"],
    "javascript": ["js"],
    "pdf": ["pdf"],
    "text": ["txt", "log"],
    "data": ["xml", "json"],
    "archive": ["zip", "rar", "7z", "tar", "gz"],
}

# Class names that the label form (as opposed to the path form) also accepts.
CLASS_NAMES_ACCEPTED_AS_LABELS = ["css", "html", "javascript", "pdf", "text", "data"]

# --- ordinal of each content class -------------------------------------------
CLASS_ORDINAL = {
    "video": 0, "audio": 1, "image": 2, "html": 3, "css": 4, "javascript": 5,
    "pdf": 6, "text": 7, "data": 8, "archive": 9, "other": 10, "unknown": 11,
}
MISSING_CLASS_ORDINAL = 11

# --- user agents ---------------------------------------------------------------
CLIENT_WORDS = [
    ("mobile", ["mobile", "android", "iphone"]),
    ("tablet", ["tablet", "ipad"]),
    ("desktop", ["chrome", "firefox", "safari", "edge"]),
]
BOT_WORDS = [
    "bot", "crawler", "spider", "scraper", "curl", "wget",
    "googlebot", "bingbot", "slurp", "duckduckbot", "baiduspider",
]

# --- access-log patterns -------------------------------------------------------
PLAIN_LINE = (
    r'^([\d.]+) - - \[([^\]]+)\] "(\w+) ([^ ]+) HTTP/[\d.]+" (\d{3}) (\d+) '
    r'"([^"]*)" "([^"]*)"'
)
EXTENDED_LINE = (
    r'^([^ ]+) \S+ \S+ \[([^\]]+)\] "([^"]+)" (\d{3}) (\d+) "([^"]+)" "([^"]+)" \S+ '
    r'cache_status=(\S+) cdn_region=(\S+) lat=(\S+) rt=(\S+)$'
)
REQUEST_FIELD = r"^(\w+)\s+([^\s]+)(?:\s+(\S+))?"
LOG_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"
CATEGORY_OF_URL = r"https?://[^/]+/([^/]+/[^/]+).*"

# --- metrics -------------------------------------------------------------------
HISTOGRAM_BOUNDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0]

# --- traffic -------------------------------------------------------------------
# (first hour, last hour, load multiplier); hours outside every band get 1.0
LOAD_BANDS = [(0, 6, 0.3), (7, 8, 0.8), (9, 11, 1.5), (12, 13, 1.2), (14, 17, 1.8),
              (18, 19, 2.0), (20, 23, 1.0)]
ZIPF_EXPONENT = 1.2
ZIPF_NUMERATOR = {"image": 6.0, "video": 5.0}
TREND_BOOST = 5

# --- trace labels --------------------------------------------------------------
LOOK_AHEAD = 100
NO_REUSE_FACTOR = 3
FUTURE_ACCESSES = 5
CACHE_OBJECTS = 100
MIN_OBJECT_ACCESSES = 2
OK_STATUSES = [200, 304]

# --- snapshot features and models ---------------------------------------------
MODEL_FEATURES = [
    "size", "type_encoded", "access_count", "age_since_last_access", "age_hours",
    "log_file_size", "access_rate", "recency_score", "stack_distance_approx",
]
FEATURE_DEFAULTS = {
    "size": 0, "type_encoded": 11, "access_count": 1, "age_since_last_access": 0.0,
    "age_hours": 0.0, "access_rate": 1.0, "recency_score": 1.0,
    "stack_distance_approx": 1000.0,
}
LRB_WEIGHTS = {"binary": 0.4, "distance": 0.3, "reuse": 0.3}
ALTERNATIVE_WEIGHTS = {"binary": 0.5, "distance": 0.25, "reuse": 0.25}
BELADY_WEIGHTS = {"binary": 0.4, "distance": 0.4, "reuse": 0.2}
BELADY_TYPES = ["image", "video", "other"]
MAX_DISTANCE = 300.0
NEUTRAL_SCORE = 0.5
FAILED_SCORE = 999999.0
CACHE_LIMIT_MB = 500

# --- decayed frequency ----------------------------------------------------------
DECAY_PER_HOUR = 0.99
DECAY_MIN_HOURS = 1.0
DROP_BELOW = 0.1
FREQUENCY_WINDOW_HOURS = 24.0
MIN_FREQUENCY = 1.0

# --- hyper-parameter grids, in MLlib names --------------------------------------
FULL_GRID = {
    "maxIter": [50, 100, 200, 300],
    "maxDepth": [3, 6, 9, 12],
    "stepSize": [0.01, 0.05, 0.1, 0.2],
    "minInstancesPerNode": [10, 20, 30, 50],
    "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
    "featureSubsetStrategy": ["0.7", "0.8", "0.9", "1.0"],
}
QUICK_GRID = {
    "maxIter": [50, 100, 200],
    "maxDepth": [6, 9],
    "stepSize": [0.05, 0.1, 0.2],
    "minInstancesPerNode": [20, 50],
    "subsamplingRate": [0.8, 1.0],
    "featureSubsetStrategy": ["0.8", "1.0"],
}
# the same search for trees with leaf limits and penalties
LEAF_GRID = {
    "trees": [50, 100, 200, 300],
    "depth": [3, 6, 9, 12, -1],
    "rate": [0.01, 0.05, 0.1, 0.2],
    "leaves": [15, 31, 63, 127],
    "least_rows": [10, 20, 30, 50],
    "row_share": [0.7, 0.8, 0.9, 1.0],
    "feature_share": [0.7, 0.8, 0.9, 1.0],
    "l1": [0, 0.1, 0.5, 1.0],
    "l2": [0, 0.1, 0.5, 1.0],
}
SEARCH_FOLDS = 3
SEARCH_SAMPLES = 50
SEED = 42

# --- edge configuration re-aimed as audits --------------------------------------
# kind of object -> seconds without an access after which it leaves the cache
RESIDENCY_SECONDS = {"media": 7 * 86400, "page": 3600}
# (kind, status) -> seconds an entry stays fresh
FRESH_SECONDS = {
    ("media", 200): 30 * 86400, ("media", 304): 30 * 86400, ("media", 404): 60,
    ("page", 200): 60, ("page", 404): 300,
}
# zone -> (requests per second, burst)
RATE_ZONES = {"media": (50, 20), "api": (10, 0)}

# --- responses -------------------------------------------------------------------
CACHE_POLICY = {
    "static": "public, max-age=2592000, immutable",
    "media": "public, max-age=2592000",
    "page": "public, max-age=3060, stale-while-revalidate=10",
    "api": "public, max-age=300",
}
POLICY_MAX_AGE = {"static": 2592000, "media": 2592000, "page": 3060, "api": 300}
REGION_FLAGS = [("EU", "🇪🇺"), ("Asia", "🇮🇩"), ("US", "🇺🇸")]
OTHER_REGION_FLAG = "🌐"
MEDIA_ROUTE = r"^/static/(images|videos|uploads)/"
HIDDEN_ROUTE = r"/\.(?!well-known)"
ENV_ROUTE = (
    r"(\.env|\.env\..*|env\.json|env\.yaml|settings\.env|\.env~|printenv\.tmp|env\.save)$"
)

# --- content catalogue ------------------------------------------------------------
UPLOAD_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "mp4", "mov", "avi"]
IMAGE_GROUPS = {"trending": (0, 9), "popular": (10, 29), "general": (30, 79), "rare": (80, 99)}
VIDEO_GROUPS = {"short-clips": (0, 9), "documentaries": (10, 29), "tutorials": (30, 59),
                "archived": (60, 65)}
