"""Values that results depend on and that therefore must be exactly these."""

# Words that are no terms.
STOP_WORDS = (
    "a an the of to in on for and or is are was were be been by with at from as that "
    "this which what who whom whose when where why how does do did it its into than then there "
    "these those can could should would will shall may might must not no yes if per vs via "
    "about above below between under over any all each some such only also our your their "
    "his her they them we you i me my he she him one two first last value"
).split()

# Kinds of files by extension.
KINDS = {
    "pdf": [".pdf"],
    "docx": [".docx"],
    "xlsx": [".xlsx", ".xlsm"],
    "csv": [".csv", ".tsv"],
    "image": [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp", ".gif"],
    "text": [
        ".txt", ".log", ".py", ".md", ".json", ".yaml", ".yml", ".ini", ".cfg",
        ".toml", ".sh", ".xml", ".html", ".htm", ".rst", ".conf", ".sql", ".js",
        ".ts", ".c", ".h", ".cpp", ".hpp", ".java", ".go", ".rs", ".env.example",
    ],
}

# Limits.
MAX_BYTES = 200 * 1024 * 1024
MAX_ROWS = 20_000
SMALL_UNIT, WINDOW_LINES, OVERLAP_LINES = 2_500, 14, 4
BM25_K1, BM25_B = 1.4, 0.7
CANDIDATES, FUSION_K, ID_WEIGHT, RESULTS = 200, 60, 1.5, 40
HEAD, BRIDGE_CHUNKS, BRIDGE_IDS, BRIDGE_EACH, BRIDGE_MAX_DF = 3, 6, 6, 3, 3
CONTEXT_CHARS, CHUNK_OVERHEAD, HEADER_CHUNKS = 24_000, 40, 2
EMBED_CHARS, WITHDRAWN_CHARS, WITHDRAWN_UNITS = 2_000, 3_000, 3
ANSWER_WORDS, ANSWER_CHARS = 8, 80
PICK_CHUNK_CHARS, PICK_FILE_CHARS = 600, 1_200
CONFIDENT = 0.9
POINTS = 20

# What stands before a question when it is embedded.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

# Patterns of blanks and line ends, of terms, and of identifiers in upper-case text.
BLANK = r"[\s\x1c-\x1f\x85]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TOKEN = r"[a-z0-9]+(?:[-_./#][a-z0-9]+)*#?"
IDENTIFIER = (
    r"(?U)\b(?:[A-Z][A-Z0-9]*(?:[-_][A-Z0-9#]+)+#?"
    r"|[A-Z]{1,4}\d{2,}[A-Z0-9]*"
    r"|0x[0-9A-Fa-f]+"
    r"|v?\d+\.\d+(?:\.\d+)+)(?![A-Za-z0-9])"
)

# Patterns of file names: extension, what separates words, where a word may begin and end.
EXTENSION = r"(?<=[^/.])(\.[^./]*)$"
NAME_SIGNS = r"[_\-.]+"
NAME_EDGE, NAME_END = r"(?:^|[_\-. ])", r"(?=$|[_\-. ])"

# Patterns of model replies: fences, an answer and file names in what is no JSON, labels, remarks.
FENCE = r"(?m)^```(?:json)?|```$"
QUOTED_ANSWER = r'"answer"\s*:\s*"((?:[^"\\]|\\.)*)"'
QUOTED_FILE = r'"([^"]+\.[A-Za-z0-9]{1,5})"'
NAMED_FILE = r"(?U)[\w./\-]+\.\w{1,5}"
ANSWER_LABEL = r"(?iU)^(?:answer|value|result)\s*[:：]\s*"
REMARK = r"(?U)\s*\([^)]*\)$"
NUMBER = r"[$€£]?\s*([-+]?\d[\d,]*(?:\.\d+)?)\s*"

# What marks a document as withdrawn, and a question as one about old revisions.
WITHDRAWN_NAME = r"withdrawn|superseded|obsolete|deprecated|retired"
WITHDRAWN_TEXT = (
    r"\bsuperseded\s+by\b"
    r"|\bthis\s+(?:revision|document|datasheet|version|edition|spec(?:ification)?)\s+(?:is|has\s+been)\s+(?:now\s+)?(?:withdrawn|superseded|obsolete|retired)\b"
    r"|\bstatus\s*[:=]\s*(?:withdrawn|superseded|obsolete|retired)\b"
    r"|\bdo\s+not\s+use\s+for\s+new\s+designs\b"
)
OLD_REVISION = r"withdrawn|superseded|obsolete|previous|older|original|earlier|\br1\b|\brev(?:ision)?\s*1\b"
LIFECYCLE = "withdrawn|superseded|obsolete|deprecated|draft|final|old|new|latest|current"
REVISION_WORDS = "r|rev|v|version"
WITHDRAWN_MARK = "  (WITHDRAWN / SUPERSEDED - do not use)"

# Answers that are none, and units that are dropped from numbers.
REFUSALS = ["", "none", "null", "n/a", "na", "unknown", "not found", "not available", "not specified", "not mentioned", "not provided", "not stated", "no answer", "not applicable", "-"]
UNITS = (
    r"°\s*[CFK]?|deg(?:rees?)?\s*[CF]?|[CF]|"
    r"seconds?|secs?|s|ms|milliseconds?|minutes?|mins?|hours?|hrs?|h|days?|weeks?|wks?|"
    r"months?|years?|%|percent|v|volts?|mv|w|watts?|a|amps?|ma|mm|cm|kg|g|"
    r"mhz|ghz|khz|hz|gb|mb|kb|tb|gib|mib|units?|pcs|pieces|usd|eur"
)

# Names and slogans on plates that are not the registration.
STATES = [
    "ALABAMA", "ALASKA", "ARIZONA", "ARKANSAS", "CALIFORNIA", "COLORADO", "CONNECTICUT",
    "DELAWARE", "FLORIDA", "GEORGIA", "HAWAII", "IDAHO", "ILLINOIS", "INDIANA", "IOWA",
    "KANSAS", "KENTUCKY", "LOUISIANA", "MAINE", "MARYLAND", "MASSACHUSETTS", "MICHIGAN",
    "MINNESOTA", "MISSISSIPPI", "MISSOURI", "MONTANA", "NEBRASKA", "NEVADA",
    "NEW HAMPSHIRE", "NEW JERSEY", "NEW MEXICO", "NEW YORK", "NORTH CAROLINA",
    "NORTH DAKOTA", "OHIO", "OKLAHOMA", "OREGON", "PENNSYLVANIA", "RHODE ISLAND",
    "SOUTH CAROLINA", "SOUTH DAKOTA", "TENNESSEE", "TEXAS", "UTAH", "VERMONT", "VIRGINIA",
    "WASHINGTON", "WEST VIRGINIA", "WISCONSIN", "WYOMING", "DISTRICT OF COLUMBIA",
]
SLOGANS = [
    "THE LONE STAR STATE", "LONE STAR STATE", "EMPIRE STATE", "THE EMPIRE STATE",
    "SUNSHINE STATE", "LAND OF LINCOLN", "GARDEN STATE", "LIVE FREE OR DIE",
    "PURE MICHIGAN", "GREAT LAKES STATE", "FIRST IN FLIGHT", "FIRST IN FREEDOM",
    "THE FIRST STATE", "GRAND CANYON STATE", "THE GOLDEN STATE", "GOLDEN STATE",
    "EXCELSIOR", "VOLUNTEER STATE", "THE VOLUNTEER STATE", "LAND OF ENCHANTMENT",
    "FAMOUS POTATOES", "BIG SKY COUNTRY", "TREASURE STATE", "THE PEACH STATE",
    "PEACH STATE", "SHOW ME STATE", "THE SHOW ME STATE", "KEYSTONE STATE",
    "VISITPA COM", "BIRTHPLACE OF AVIATION", "THE HAWKEYE STATE", "GREEN MOUNTAIN STATE",
    "WILD WONDERFUL", "ALMOST HEAVEN", "AMERICA'S DAIRYLAND", "AMERICAS DAIRYLAND",
    "10,000 LAKES", "10000 LAKES", "SPORTSMAN'S PARADISE", "SPORTSMANS PARADISE",
    "THE OCEAN STATE", "OCEAN STATE", "CONSTITUTION STATE", "THE SILVER STATE",
    "SILVER STATE", "THE BEEHIVE STATE", "LIFE ELEVATED", "GREATEST SNOW ON EARTH",
    "VACATIONLAND", "THE SPIRIT OF AMERICA", "SPIRIT OF AMERICA", "THE NATURAL STATE",
    "NATURAL STATE", "ALOHA STATE", "PRAIRIE STATE", "THE COWBOY STATE", "SOONER STATE",
    "NATIVE AMERICA", "TAXATION WITHOUT REPRESENTATION", "END TAXATION WITHOUT REPRESENTATION",
    "DMV CA GOV", "USA", "U S A", "COUNTY", "DEALER", "STATE OF",
]
BANNER_ADDRESS = r"\S*(?:WWW|\.COM|\.GOV|\.ORG|\.NET|\.US)\S*"
#: Characters that stand for the middle dot of a plate.
DOTS = "・‧•∙･"
OCR_MAX_SIDE, OCR_MIN_SIDE, CORPUS_MIN_SIDE = 1_600, 640, 448
