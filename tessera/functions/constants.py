"""Fixed values of the text rules: word lists, patterns and unit spellings.

They decide results, so they are stated here once and used by the column functions and by the
SQL that checks them.
"""

# Words without discriminative content.
STOPWORDS = tuple(
    """
    a an the and or but if then than that this these those there here
    is are was were be been being am do does did doing done
    have has had having will would shall should can could may might must
    of in on at to for from by with without within into onto over under
    as it its it's their they them he she his her you your we our us i
    not no nor so such about between during above below up down out off again
    further once each few more most other some any all both very
    what which who whom whose when where why how
    also however therefore thus hence per via e.g i.e etc
    """.split()
)
# Words of the asking, ignored by the subject gate alone.
QUESTION_FRAME = ("according", "source", "sources", "held")

# Patterns of words, numbers with units, quotations and citations.
WORD = r"[A-Za-z][A-Za-z0-9\-/+']*|\d+(?:[.,]\d+)*"
NUMBER = r"(?<![\p{L}\p{N}_.])(\d+(?:[.,]\d+)?)\s*(°\s?[CF]|µ?[A-Za-z]+(?:[- ][A-Za-z]+)?)?"
QUOTED = r'"([^"]{4,120})"'
CITATION = r"\[(\d+)\]"
LEADING_CITATIONS = r"^((?:\[\d+\]\s*)+)"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z\[\"'(])"
PACK_GAP = r"(?<=[.!?;])\s+"

# Spellings of each unit, by its canonical form.
UNITS = {
    "%": ("%", "percent", "pct"),
    "°c": ("c", "°c", "degc", "celsius", "degrees celsius", "degree celsius", "deg c"),
    "°f": ("f", "°f", "fahrenheit", "degrees fahrenheit"),
    "k": ("k", "kelvin"),
    "v": ("v", "volt", "volts"),
    "a": ("a", "amp", "amps", "ampere", "amperes"),
    "ah": ("ah", "amp hour", "amp hours", "ampere hour", "ampere hours"),
    "wh": ("wh", "watt hour", "watt hours", "watt-hour", "watt-hours", "watthour", "watthours"),
    "kwh": ("kwh", "kilowatt hour", "kilowatt hours"),
    "mwh": ("mwh", "megawatt hour", "megawatt hours"),
    "w": ("w", "watt", "watts"),
    "kw": ("kw", "kilowatt", "kilowatts"),
    "mw": ("mw", "megawatt", "megawatts"),
    "mm": ("mm", "millimetre", "millimetres", "millimeter", "millimeters"),
    "cm": ("cm", "centimetre", "centimetres"),
    "m": ("m", "metre", "metres", "meter", "meters"),
    "km": ("km", "kilometre", "kilometres"),
    "kg": ("kg", "kilogram", "kilograms"),
    "g": ("g", "gram", "grams", "gramme", "grammes"),
    "mg": ("mg", "milligram", "milligrams"),
    "s": ("s", "sec", "second", "seconds"),
    "min": ("min", "minute", "minutes"),
    "h": ("h", "hr", "hour", "hours"),
    "bar": ("bar",),
    "kpa": ("kpa",),
    "mpa": ("mpa",),
    "pa": ("pa",),
    "psi": ("psi",),
    "ppm": ("ppm",),
    "ppb": ("ppb",),
    "µm": ("µm", "micron", "microns", "micrometre"),
}
UNIT_OF = {spelling: unit for unit, spellings in UNITS.items() for spelling in spellings}

# Claim rules.
REQUIREMENT = r"(?i)\b(shall|must|is required to|are required to|may not|shall not|must not|is prohibited|required by|mandates?|prohibits?)\b"
DEFINITION = r"(?i)\b(is defined as|means|refers to|is the term|is a process|is a|are a)\b"
RANGE = r"(?i)(\d+(?:\.\d+)?)\s*(?:-|–|to|and)\s*(\d+(?:\.\d+)?)\s*(°C|°F|%|V|Ah|Wh|kWh|MWh|kW|MW|bar|ppm)"
NOISE = r"(?i)^(see also|contents|table of contents|figure \d|page \d|references?|copyright|all rights reserved|cookies?|skip to)\b"
CLAIM_CHARS = (40, 500)

# Headings and bibliographies.
HEADING = r"^(?:#{1,6}\s+.+|\d+(?:\.\d+){0,3}\.?\s+[A-Z][^\n]{2,90})$"
BIBLIOGRAPHY = r"(?im)^#{0,6}[ \t]*(?:references|bibliography|works cited|literature cited)[ \t]*:?[ \t]*$"

# Sentences about the answer, apparatus words, prose that is none.
META = (
    r"(?i)\b(evidence (is|was) (not )?(sufficient|insufficient)|this answer is|the sources? (do not|does not|available)|i (cannot|can't|could not)|no (relevant )?evidence|"
    r"not enough (evidence|information)|out of scope|assembled from the cited|without inference beyond|based on the cited (passages|evidence|sources))\b"
)
ANSWER_HEADING = r"(?i)^(ANSWER|REASONING|SOURCES|LIMITATIONS|CONFIDENCE)\b"
APPARATUS = tuple(
    """cite cited citation citations passage passages source sources evidence stated state states according above below section quoted quote
    reference referenced answer question excerpt extract document text directly taken drawn provided given shown""".split()
)
NOT_PROSE = (
    r"(?i)(journal of|proceedings of|\bvol\.|\bpp\.|\bdoi:|et al\.,|\bissn\b|\bisbn\b|^fig\.|^figure \d|^table \d|^appendix\b|^abstract$|^\s*\[\d+\])"
)
NUMERIC_CUES = ("what temperature", "how hot", "how many", "how much", "how long", "what pressure", "at what", "how often", "what is the limit", "threshold")
REQUIREMENT_CUES = ("must", "shall", "required", "permitted", "allowed", "mandatory", "obligation", "compliant", "legal")
REQUIREMENT_WORDS = (" shall ", " must ", "required", "prohibited")
VERBATIM_CUES = ("word for word", "verbatim", "reproduce", "quote", "exact text", "exact wording", "full text", "recite", "transcribe", "in full", "copy of the", "read out the")

# Cues of a source type in a question.
TYPE_CUES = {
    "regulatory": ("regulation", "regulatory", "legally", "law", "statutory", "directive", "regulator", "mandated", "compliance", "permitted"),
    "standard": ("standard", "standards", "clause", "certification", "test method", "conformity", "specification"),
    "investigation": ("incident", "accident", "investigation", "failure report", "post-incident", "root cause", "case study", "inquiry"),
    "academic": ("study", "studies", "research", "paper", "literature", "experiment", "measured", "journal", "preprint"),
    "industry": ("industry", "vendor", "manufacturer", "guidance", "best practice"),
    "dataset": ("dataset", "data set", "measurements", "test data"),
    "reference": ("definition", "what is", "overview", "background"),
    "official_record": ("registered", "register", "incorporated", "filing", "filings", "legal name", "company number", "officers", "directors"),
    "press": ("news", "reported", "press", "announced", "headline", "coverage"),
    "review": ("reviews", "review", "rating", "ratings", "complaints", "testimonial"),
    "community": ("users say", "developers say", "discussion", "forum", "community"),
}
SINCE = r"(?i)\b(since|after|from)\s+((?:19|20)\d{2})\b"
BEFORE = r"(?i)\b(before|prior to|up to)\s+((?:19|20)\d{2})\b"
LATEST = r"(?i)\b(latest|current|most recent|newest|up to date|today)\b"

# Statuses that count as declining to answer, and the confidence bands.
ABSTAINED = ("insufficient_evidence", "out_of_scope", "ambiguous", "unsupported", "irrelevant")
UNCERTAIN = ("depends", "varies", "ambiguous", "unclear", "not established", "range", "conditions", "insufficient", "which", "could mean", "chemistry", "clarify", "specify")
#: metric -> (better direction, gated)
METRICS = {
    "retrieval_precision": ("higher", False), "retrieval_recall": ("higher", True), "answer_correctness": ("higher", True), "citation_validity": ("higher", True),
    "citation_relevance": ("higher", False), "unsupported_claim_rate": ("lower", True), "hallucination_rate": ("lower", True), "abstention_correctness": ("higher", True),
    "source_coverage": ("higher", False), "corpus_freshness_days": ("lower", False), "contradiction_rate": ("lower", False), "regression_rate": ("lower", True),
}

# Ranking parameters.
BM25_K1, BM25_B, SECTION_WEIGHT = 1.2, 0.75, 0.6
FUSION_K, AUTHORITY_WEIGHT, HALF_LIFE_DAYS = 60, 0.15, 1460
FUSION_WEIGHTS = {"keyword": 1.0, "semantic": 1.0, "structured": 0.6, "graph": 0.5}
TOP_K, CANDIDATE_K = 8, 40
