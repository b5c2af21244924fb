"""Fixed values that results depend on: word lists, patterns and limits.

Everything here is a plain constant. Patterns use Java regex syntax; word edges are
spelled as ASCII look-arounds because Java's ``\\b`` follows Unicode letters.
"""

# --- limits (fixed values) ---
CARDS_PER_QUERY = 5
FULL_DOCUMENTS = 3
PASSAGE_CHARS = 26_000
MIN_PASSAGE_CHARS = 13_500
WINDOW_TOKENS = 24_000
OUTPUT_TOKENS = 3_000
RESERVE_TOKENS = 2_000
CHARS_PER_TOKEN = 3.5
HISTORY_TURNS = 12
HISTORY_CHARS = 9_000
MESSAGE_CHARS = 8_000
SCREEN_WINDOW = 2_000
SCREEN_OVERLAP = 200
BIRTH_DATE_GAP = 48
RECORD_NUMBER_GAP = 12
SNIFF_CHARS = 240
SAMPLE_WORDS = 60
SAMPLE_MIN_WORDS = 10
STOP_SHARE_MAX = 0.85
DISTINCT_SHARE_MIN = 0.2
DECLARATION_CHARS = 256
HEADING_PARTIAL_CHARS = 32
RULE_BLOCK_CHARS = 1_500
RULE_LINES = 12
RULE_MAX_CHARS = 400
RULE_MIN_CHARS = 25
RULE_LINE_OVERHEAD = 5
RULES_HEADING = "Rules stated in these passages"
QUOTE_MAX_CHARS = 420
QUOTE_THRESHOLD = 0.75
QUOTE_MIN_TOKENS = 8
OWNER_MIN_SCORE = 0.8
OWNER_SECOND_RATIO = 0.6
OWNER_PICKS = 2
PRODUCT_WEIGHT = 0.3
FOLLOW_UP_WORDS = 4
OWNER_BLOCK_CHARS = 800
REASON_CHARS = 110
DIRECTORY_CHARS = 9_000
TEAM_STRUCTURE_CHARS = 5_500
MATCH_THRESHOLD = 0.01
RERANK_THRESHOLD = 0.001
DEFAULT_RESULTS = 15
MAX_RESULTS = 50
MONTHLY_CAP = 2_500
PURGE_DAYS = 7
DIRECTORY_TTL_SECONDS = 300
GENERATION_ATTEMPTS = 3
RRF_K = 60  # from the published reciprocal-rank-fusion paper
CATEGORY_PRIORITY = [
    "SOP", "Reference", "Care Support", "All Ops", "Expansion Team",
    "Physical clinic", "Strategy", "Planning",
]
UNTITLED = "Untitled"
WITHHELD = "[withheld]"

# --- word edges and white space ---
W0 = r"(?<![A-Za-z0-9_])"  # before a word
W1 = r"(?![A-Za-z0-9_])"   # after a word
WS = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_CHARS = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NOT_WS = WS.replace("[", "[^", 1)

# --- identifier patterns (fixed values) ---
SSN = r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
PHONE = rf"(?<![0-9])(?:\+?1(?:[.-]|{WS})?)?\(?[0-9]{{3}}\)?(?:[.-]|{WS})?[0-9]{{3}}(?:[.-]|{WS})?[0-9]{{4}}(?![0-9])"
BIRTH_KEYWORD = rf"(?i){W0}(?:d\.?{WS}?o\.?{WS}?b|date{WS}+of{WS}+birth|born){W1}"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DATE = (
    rf"(?i){W0}[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}{W1}"
    rf"|{W0}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{W1}"
    rf"|{W0}{_MONTH}\.?{WS}+[0-9]{{1,2}}(?:st|nd|rd|th)?,?{WS}+[0-9]{{4}}{W1}"
    rf"|{W0}[0-9]{{1,2}}(?:st|nd|rd|th)?{WS}+(?:of{WS}+)?{_MONTH}\.?,?{WS}+[0-9]{{4}}{W1}"
)
RECORD_KEYWORD = (
    rf"(?i){W0}(?:mrn|chart|record{WS}+number|patient{WS}*(?:number|id|no)){W1}\.?"
    rf"|{W0}(?:record|patient){WS}*#"
)
NAMED_PHRASE = rf"(?i){W0}(?:patient(?:['’]s)?{WS}+name{WS}+is|patient{WS}+(?:named|called)){WS}+\S+"
HONORIFIC = rf"{W0}(?:Mr|Mrs|Ms|Miss)\.?{WS}+[A-Z][a-z]+"
STREET = (
    rf"{W0}[0-9]{{1,6}}{WS}+(?:[A-Z][a-z]{{1,15}}{WS}){{1,3}}"
    r"(?:[Ss]treet|[Ss]t|[Aa]venue|[Aa]ve|[Rr]oad|[Rr]d|[Bb]oulevard|[Bb]lvd|[Ll]ane|[Ll]n"
    rf"|[Dd]rive|[Dd]r|[Cc]ourt|[Cc]t|[Pp]lace|[Pp]l|[Ww]ay){W1}"
)
MEMBER_ID = (
    rf"(?i){W0}(?:member|policy|subscriber|insurance){WS}*(?:id|#|number)?{WS}*[:#]?{WS}*"
    r"(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9-]{6,}"
)
_NAME_TAIL = r"(?:[A-Z][a-z]+|Van|De|La|Da|Le|Mac|Mc)"
RELATION_NAME = (
    rf"{W0}(?:patient|caregiver|wife|husband|spouse|son|daughter|mother|father|mom|dad){W1}"
    rf"([^.!?\n]{{0,20}}?){WS}(?:[A-Z][a-z]+(?:{WS}+{_NAME_TAIL})+){W1}"
)
PREPOSITION = rf"(?i){W0}(?:in|at|from|to|for|with|the|a|an|of|by|near|on){W1}"
POSSESSIVE_NAME = (
    rf"{W0}[A-Z][a-z]+(?:{WS}+(?:[A-Z][a-z]+|Van|De|La|Da|Le))+['’]s{WS}+"
    rf"(?:chart|visit|appointment|record|file|order|results?){W1}"
)
HEX_OR_UUID = (
    "(?i)[0-9a-f]{32}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
)
COURTESY = r"(?i)^(thanks|thank you|thanks so much|ty|thx|cheers)[.! ]*$"
CHANNEL_OR_PERSON = r"(?i)#[a-z][a-z0-9_-]{2,}|@[a-z]"
TYPED_URL = rf"\(?https?://{NOT_WS}+\)?"
DRAFT_TITLE = rf"\((?:DRAFT|Draft){W1}[^)]*\){WS}*$"

# --- error kinds, most specific first (fixed values) ---
ERROR_KINDS = [
    ("allocation", r"(?i)allocation.?exceeded|7094"),
    ("spend-limit", r"(?i)budget|spend.?limit|cost.?limit"),
    ("context-overflow", r"(?i)5021|context.?window|context length|too many tokens|maximum context"),
    ("rate-limit", r"(?i)rate.?limit|429"),
]

# --- query hints (fixed values) ---
QUERY_HINTS = [
    (rf"(?i){W0}referrals?{W1}", "referral acceptance criteria inbound referral records request"),
    (rf"(?i){W0}pre(?:-|{WS})?visit{W1}", "pre-visit checklist chart prep before visit"),
]

# --- stop words of the collapse check (fixed values) ---
COLLAPSE_STOPWORDS = (
    "a an the of to in and or is are was were be been it its this that these those for on at "
    "by with as from but not no if then so than too very can will do does did has have had he "
    "she they we you i me my your our their his her them us what which who when where how"
).split()

# --- stop words of owner matching (fixed values) ---
OWNER_STOPWORDS = (
    "about after again all also and any anything are ask asked asking back because been being "
    "but call called calling can come could day did does doing done each even every for from "
    "get gets getting got had has have having help her here him his how into its just know "
    "last like make many may more most much need needs never new next not now off once one "
    "only other our out over own owns please really said says see seem seems send sent she "
    "should since some someone something still such sure than that the their them then there "
    "these they thing this those through today told tomorrow too two under until very want "
    "wants was way week well were what when where whether which while who whom whose why will "
    "with would yesterday you your morning afternoon evening tonight monday tuesday wednesday "
    "thursday friday saturday sunday patient member family visit question team handle handles "
    "handling message contact issue work person ins task escalate escalated escalating "
    "escalation resolve resolved unsure first point specific listed above"
).split()

# --- stop words of topic overlap (fixed values) ---
TOPIC_STOPWORDS = (
    "about after all and any anything for from into issue issues once own question questions "
    "that the their this when with"
).split()

# --- headings of a structured answer, in order (fixed values) ---
ANSWER_HEADINGS = [
    "Situation", "Urgency", "Who handles this", "Answer", "Before you start", "Do now", "Then",
    "Tell the patient", "Stop and escalate", "Done when", "What the SOPs say",
    "Not covered by the SOPs", "One question",
]
LEVELS = ["error", "reference", "conflict", "gap", "note"]
PRIORITIES = ["P0", "P1", "P2"]

# --- rule lexicon (fixed values) ---
_SPELLED = (
    "prescriber|prescribing provider|provider|clinician|physician|care navigator|care team|"
    "nurse|pharmacist|billing owner|billing|RCM|team lead|compliance"
)
_ROLE = _SPELLED + "|NP|PA|MA|MD"
NEVER = rf"(?i){W0}never{W1}"
NEVER_FACT = (
    rf"(?i){W0}(?:almost|often|rarely|was|were|has|have|had|calls?)\s+never{W1}"
    rf"|{W0}never\s+(?:placed|arrived|get|gets|got|used){W1}"
)
RULE_TERMS = [
    ("must-not", rf"(?i){W0}must(?:\s+not|n['’]t|\s+never){W1}"),
    ("not-allowed", rf"(?i){W0}not\s+(?:allowed|permitted){W1}|{W0}prohibited{W1}|{W0}forbidden{W1}"),
    ("on-their-own", rf"(?i){W0}(?:never|not|no){W1}[^.?]*{W0}on their own{W1}|{W0}(?:ops|staff){W1}[^.?]*{W0}on their own{W1}"),
    ("only-role", rf"(?i){W0}only\s+(?:the\s+|a\s+|an\s+)?(?:{_ROLE})s?{W1}"),
    ("role-decides", rf"(?i){W0}(?:{_ROLE})s?\s+(?:selects?|decides?|chooses?|determines?|makes?\s+(?:that|the)\s+call|signs?|approves?|authori[sz]es?){W1}"),
    ("by-role", rf"(?i){W0}(?:chosen|selected|decided|determined|approved|signed|ordered|prescribed)\s+(?:(?:by\s+)?(?:the\s+|a\s+)?(?:{_SPELLED})s?|by\s+(?:the\s+|a\s+)?(?:NP|PA|MA|MD)s?){W1}"),
    ("via-role", rf"(?i){W0}via\s+(?:the\s+|a\s+)?(?:{_ROLE})s?{W1}"),
    ("route-to-role", rf"(?i){W0}route[ds]?\s+(?:\w+\s+){{0,4}}?(?:to|through)\s+(?:the\s+|a\s+|your\s+)?(?:{_ROLE})s?{W1}"),
    ("route-to-process", rf"(?i){W0}route[ds]?\s+(?:\w+\s+){{0,4}}?(?:to|through)\s+(?:the\s+)?(?:[\w&-]+\s+){{0,3}}?(?:SOP|process|policy|protocol){W1}"),
    ("must-come-from", rf"(?i){W0}must\s+come\s+from\s+(?:the\s+|a\s+)?(?:{_ROLE})"),
    ("no-by-ops", rf"(?i){W0}no\s+[\w/ -]{{0,30}}\s+by\s+(?:ops|staff){W1}"),
    ("ops-may-not", rf"(?i){W0}(?:ops|staff|coordinators?)\s+(?:may|can)(?:not|\s+not|['’]t){W1}"),
]
DO_NOT = (
    rf"(?i){W0}(?:do not|don['’]t){W1}(?!\s+(?:need|require|have to|worry|hesitate|yet|"
    r"automatically|currently|always|come to))"
)
# lower-case pieces of which each match of a term holds at least one; no term is tried on a unit without them
RULE_SIGNS = {
    "never": ["never"], "must-not": ["must"], "not-allowed": ["allowed", "permitted", "prohibited", "forbidden"], "on-their-own": ["on their own"],
    "only-role": ["only"], "role-decides": ["select", "decide", "choose", "determine", "make", "sign", "approve", "authori"],
    "by-role": ["chosen", "selected", "decided", "determined", "approved", "signed", "ordered", "prescribed"], "via-role": ["via"],
    "route-to-role": ["route"], "route-to-process": ["route"], "must-come-from": ["must"], "no-by-ops": ["ops", "staff"],
    "ops-may-not": ["ops", "staff", "coordinator"], "do-not": ["do not", "don't", "don’t"],
}

# fixed values: opening lines of the owner block and of a team structure's closing parts
OWNER_HEADING = "Team directory match for this message (computed from the team directory; see hard rule 17):"
NO_OWNER = "Team directory match for this message: no entry's Owns line names this work. Name no person."
HANDOFFS_HEADING = "Handoffs (criteria, not timelines; crossing one involves both teams):"
OUTSIDE_HEADING = "Outside Operations (say so, and name the Operations function that coordinates):"

# fixed values: what a blocked answer shows in place of its text
BLOCKED_LINES = {
    "none": "No SOP directly covers this. The closest SOPs are below — check those, then ask your team lead if they do not answer it.",
    "unconfirmed": "SOP coverage for this request could not be confirmed. The closest SOPs are below; ask your team lead if they do not answer it.",
}
