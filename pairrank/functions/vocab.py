"""Default vocabulary of the text extractor. Fixed values; every operator takes its own instead."""

# Codes and the phrases that stand for them.
CERTIFICATIONS = {
    "security_licence": (
        "SIA licence",
        "SIA license",
        "S.I.A. licensed",
        "security licence",
        "security license",
        "SIA badge",
        "SIA-licensed guard",
        "valid SIA licence (front line)",
    ),
    "first_aid": (
        "first aid",
        "first-aid certified",
        "First Aid at Work",
        "FAW certificate",
        "emergency first aid at work",
        "EFAW",
    ),
    "cpr": (
        "CPR",
        "C.P.R. certified",
        "cardiopulmonary resuscitation",
        "CPR and AED trained",
        "CPR qualified",
    ),
    "fire_safety": (
        "fire safety",
        "fire marshal",
        "fire warden",
        "fire safety awareness",
        "fire marshall training",
    ),
    "cctv_operation": (
        "CCTV",
        "CCTV operation",
        "C.C.T.V. operator",
        "public space surveillance (CCTV)",
        "CCTV monitoring",
        "closed circuit television operation",
    ),
    "conflict_management": (
        "conflict management",
        "conflict resolution",
        "de-escalation training",
        "physical intervention",
        "conflict management training",
    ),
    "dog_handling": (
        "dog handling",
        "K9 handling",
        "canine handling",
        "security dog handler",
        "NASDU dog handling",
    ),
    "close_protection": (
        "close protection",
        "CP licence",
        "executive protection",
        "close protection officer",
        "bodyguard training",
    ),
    "health_and_safety": (
        "health and safety",
        "health & safety",
        "H&S certificate",
        "IOSH Working Safely",
        "health and safety level 2",
    ),
}

SHIFTS = {
    "day": ("day shifts", "daytime cover", "day duty", "days"),
    "night": ("night shifts", "nights", "night duty", "overnight cover", "nightshift"),
    "weekend": ("weekends", "weekend cover", "Saturdays and Sundays", "weekend shifts"),
    "rotating": ("rotating shifts", "rotating rota", "4 on 4 off", "shift rotation", "rotating pattern"),
}

SITES = {
    "retail": ("retail", "shopping centre", "department store", "retail park", "high street store"),
    "corporate": (
        "corporate",
        "office building",
        "corporate headquarters",
        "business park",
        "reception and front of house",
    ),
    "construction": ("construction site", "building site", "construction", "site security"),
    "event": ("event security", "concerts and festivals", "stadium", "large events", "crowd control at events"),
    "residential": ("residential", "gated community", "apartment complex", "residential estate"),
    "industrial": ("industrial", "warehouse", "distribution centre", "manufacturing plant", "logistics depot"),
}

CRITICAL = ("security_licence",)

NUMBER_WORDS = {
    "no": 0,
    "one": 1,
    "two": 2,
    "three": 3,
    "four": 4,
    "five": 5,
    "six": 6,
    "seven": 7,
    "eight": 8,
    "nine": 9,
    "ten": 10,
    "eleven": 11,
    "twelve": 12,
    "fifteen": 15,
    "twenty": 20,
}

EXPERIENCE_SECTIONS = ("EXPERIENCE", "WORK HISTORY", "EMPLOYMENT", "CAREER HISTORY")
REFERENCE_YEAR = 2026
MAX_TEXT_LENGTH = 20_000

# Patterns. A look at the first letter comes before what costs more.
YEARS_DIGITS = r"(?iU)(\d{1,2}(?:\.\d)?)\s*\+?\s*years?['’]?\s*(?:of\s+)?(?:security\s+)?(?:experience|in\s+the\s+security|in\s+security)"
YEARS_WORDS = (
    r"(?iU)(?=[" + "".join(sorted({w[0] for w in NUMBER_WORDS})) + r"])\b(" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + r")\s+years?\s+(?:of\s+)?(?:security\s+)?experience"
)
PERIOD = r"(?iU)\((\d{4})[\s&&[^\n]]*[-–][\s&&[^\n]]*(present|\d{4})\)"  # within a line
NO_ROLES = r"(?iU)no\s+previous\s+security\s+roles"
SITE_TAIL = r"\)\s*[-–]\s*(.+)$"
NO_DRIVING = r"(?iU)(?=[nd])(?:no\s+driving\s+licence|does\s+not\s+drive|driving\s+licence\s*:\s*none)"
HAS_DRIVING = r"(?iU)(?=[fdh])(?:full[\w\s]*driving\s+licence|driving\s+licence\s*:\s*full|holds\s+a\s+full)"
