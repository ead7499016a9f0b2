"""Word lists, patterns, bounds and formats that define the results.

Everything in this module is a given of the domain.  The patterns use the usual
regex shorthands (``\\s``, ``\\d``, ``\\w``, ``\\b``) with their Unicode meaning;
``postlens.functions.text.java_regex`` turns them into Java classes with exactly
that meaning before they reach Spark.
"""

# --------------------------------------------------------------------------
# Patterns of the field extraction, matched on normalised text
# --------------------------------------------------------------------------
RK = r"(\d)\s*rk\b"
BHK = r"(\d(?:\.\d)?)\s*bhk\b"

RENT = (
    r"rent\s*[:\-–]\s*(?:rs\.?|₹|inr)?\s*([\d,]+)",
    r"(?:rs\.?|₹|inr)\s*([\d,]+)\s*/?\s*(?:month|mo|pm|per\s*month)",
    r"rent\s+(?:is\s+)?(?:rs\.?|₹|inr)?\s*([\d,]+)",
    r"rent\s+(?:of\s+)?(?:flat\s+)?(?:rs\.?|inr)?\s*([\d,]+)",
    r"([\d,]+)\s*/?\s*(?:month|mo|pm)\b",
    r"(\d{1,2})[.\s]*k\s*(?:rent|per\s*month|/\s*month|pm)",
    r"rent\s*[:\-–]?\s*(\d{1,2})[.\s]*k\b",
    r"budget\s*[:\-–]?\s*(?:rs\.?|₹)?\s*([\d,]+)",
)
RENT_SPAN = r"(\d{1,2})\s*k?\s*[-–to]+\s*(\d{1,2})\s*k"
RENT_BOUNDS = (1_000, 500_000)
RENT_IN_THOUSANDS_BELOW = 100

DEPOSIT = (
    r"deposit\s*[:\-–]\s*(?:rs\.?|₹|inr)?\s*([\d,]+)",
    r"(?:advance|security)\s*[:\-–]?\s*(?:rs\.?|₹|inr)?\s*([\d,]+)",
)
DEPOSIT_BOUNDS = (1_000, 1_000_000)

MAINTENANCE = r"maintenance\s*[:\-–]?\s*(?:rs\.?|₹)?\s*([\d,]+)"
MAINTENANCE_BOUNDS = (100, 50_000)

SQFT = r"(\d{3,5})\s*(?:sq\.?\s*ft|sft|sqft|square\s*feet)"
SQFT_BOUNDS = (100, 50_000)

CONTACT = r"(?:\+91[\s-]?)?([6-9]\d{9})"
FLOOR = r"(\d{1,2})\s*(?:th|st|nd|rd)?\s*floor"
FACING = r"(east|west|north|south)\s*[-\s]?\s*facing"

FURNISHED = (
    (r"un\s*-?\s*furnish", "unfurnished"),
    (r"semi\s*-?\s*furnish", "semi"),
    (r"full\w*\s*-?\s*furnish", "fully"),
)

CAR_PARKING = r"car\s*park"
BIKE_PARKING = r"(?:bike|two.?wheeler|2.?wheeler)\s*park"

LEASE = (
    r"(\d{1,2})\s*months?\s*(?:lease|lock|agreement)",
    r"(?:lease|lock|agreement)\s*[:\-]?\s*(\d{1,2})\s*months?",
)

AVAILABLE_NOW = r"immedia|ready\s*to\s*move|instant\s*move"
MONTHS = (
    "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|"
    "june|july|august|september|october|november|december"
)
DAY_MONTH = rf"(\d{{1,2}})\s*(?:st|nd|rd|th)?\s*(?:of\s+)?({MONTHS})"
MONTH_DAY = rf"({MONTHS})\s*(\d{{1,2}})"
WEEK_OF_MONTH = rf"(\d{{1,2}})(?:st|nd|rd|th)?\s*week\s*(?:of\s+)?({MONTHS})"

AMENITIES = (
    ("lift", r"\blift\b"),
    ("gym", r"\bgym\b"),
    ("swimming pool", r"swimming\s*pool"),
    ("security", r"\bsecurity\b|cctv"),
    ("power backup", r"power\s*backup|generator|dg\s*set"),
    ("balcony", r"\bbalcon"),
    ("parking", r"\bparking\b"),
    ("wifi", r"\bwifi\b|wi-fi"),
    ("ac", r"\bac\b|air\s*condition"),
    ("geyser", r"\bgeyser\b"),
    ("washing machine", r"washing\s*machine"),
    ("fridge", r"\bfridge\b|refrigerator"),
    ("ro", r"\bro\b|water\s*purifier"),
    ("modular kitchen", r"modular\s*kitchen"),
)

GATED = (
    r"gated\s*(?:community|society|complex)",
    r"gated\s*apartment",
    r"apartment\s*complex",
    r"(?:prestige|aparna|my\s*home|mantri|smr|salarpuria|ramky|pbel|brigade)\s+\w+",
)

# Areas looked up in the text, in reporting order
AREAS = (
    "kondapur", "gachibowli", "madhapur", "hitech city", "hi-tech city",
    "manikonda", "nanakramguda", "financial district", "kokapet",
    "narsingi", "tellapur", "nallagandla", "miyapur", "kukatpally",
    "kphb", "wipro circle", "banjara hills", "jubilee hills",
    "begumpet", "ameerpet", "sr nagar", "sanath nagar",
    "tolichowki", "mehdipatnam", "attapur", "rajendra nagar",
    "shamshabad", "lb nagar", "dilsukhnagar", "uppal",
    "secunderabad", "kompally", "bachupally", "nizampet",
    "pragathi nagar", "chandanagar", "lingampally", "gowlidoddy",
    "sheikhpet", "raidurg", "botanical garden", "mindspace",
    "hitec city", "serilingampally", "hafeezpet", "allwyn colony",
    "whitefields", "whitefield", "kismatpur", "bandlaguda",
    "peeramcheru", "mokila", "gopanpally", "khajaguda",
    "kothaguda", "raghavendra colony", "sriram nagar",
)
AREAS_REPORTED = 3

# --------------------------------------------------------------------------
# Keyword classes, matched on the lower-cased original text
# --------------------------------------------------------------------------
FLATMATE_SIGNALS = (
    "flatmate", "flat mate", "roommate", "room mate", "sharing", "shared room",
    "looking for a", "replacement", "occupant", "vacancy in",
)
ROOM_SIGNALS = (
    "single room", "1 room available", "private room", "room available",
    "room for rent", "1 room in",
)
NON_VEG_SIGNALS = (
    "non-veg", "non veg", "nonveg", "no food restriction",
    "no restriction on food", "all food habits welcome",
)
VEG_SIGNALS = (
    "vegetarian", "veg only", "pure veg", "veg preferred",
    "strictly veg", "veg food only", "satvik", "brahmin",
    "jain food", "no non-veg", "no nonveg",
)
FEMALE_SIGNALS = (
    "female only", "only female", "girls only", "only for female",
    "only for girls", "female flatmate", "female roommate",
    "looking for a female", "women only",
)
MALE_SIGNALS = (
    "male only", "only male", "boys only", "only for male",
    "only for boys", "male flatmate", "male roommate",
    "looking for a male", "men only",
)
NO_BROKERAGE_SIGNALS = (
    "no broker", "no brokerage", "direct owner", "owner direct",
    "zero brokerage", "without broker", "broker free",
)

# Spellings accepted by the normalisers
PARKING_BOTH = ("both", "car and bike", "bike and car", "2 car")
PARKING_BIKE = ("bike", "two-wheeler", "2 wheeler")
RENT_IN_TEXT = r"(\d{4,6})"
BHK_IN_TEXT = r"(\d\.?\d?)"

# Plausibility of model output
MODEL_JSON_FIRST = r"\{.*?\}"
MODEL_JSON_WIDEST = r"\{.*\}"
MONTH_ABBREVIATIONS = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
)
BOLD_DIGITS = "𝟬𝟭𝟮𝟯𝟰𝟱𝟲𝟳𝟴𝟵"

# --------------------------------------------------------------------------
# Near-copy rule, search, paging and corpus
# --------------------------------------------------------------------------
MIN_POST_CHARS = 50
HEAD_CHARS = 80

PAGE_SIZE = 12
COMMAND_LIMIT = 20
DEFAULT_LIMIT = 50
PREVIEW_CHARS = 150

MIN_TRAINING_CHARS = 30
TRAIN_SHARE = 0.9
TRAINING_PROMPT = (
    "Extract these fields from the flat rental post. Return JSON only.\n"
    'Fields: gated_community (bool), furnished ("fully"/"semi"/"unfurnished"), '
    "available_from (date/string), amenities (list)\n"
    "Use null for missing values.\n"
    "\n"
    "Post: "
)
TRAINING_SYSTEM = "You extract flat rental info from Facebook posts. Return JSON only."

# Page extraction
PERMALINK_NEEDLES = ("/posts/", "/permalink/", "story_fbid", "?comment_id")
IMAGE_NEEDLES = ("scontent",)
IMAGE_EXCLUDED = ("emoji", "50x50", "36x36")
TITLE_EXCLUDED = "Notifications"
TITLE_MIN_CHARS = 3
