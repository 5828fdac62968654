"""Word lists, phrase lists and thresholds that results depend on."""

#: Words that say nothing about whether a requirement is met.
STOPWORDS = (
    "a an and or the to of in on at for with by from as is are be been being have has had will would can could should must may "
    "you your we our us they their it this that these those experience years year strong excellent good great solid ability able "
    "work working knowledge familiar familiarity understanding proficiency proficient skills skill plus bonus nice preferred "
    "required requirements using use used such including etc other others well least more most some any"
).split()

#: Quantities written in words.
NUMBER_WORDS = {
    **{w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())},
    **{w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)},
    "hundred": 100,
    "thousand": 1000,
    "million": 1_000_000,
    "billion": 1_000_000_000,
}

#: Weights of the score's components, and the endings of a tool's name used as a verb.
WEIGHTS = {"hard_skills": 0.40, "qualifications": 0.15, "title_fit": 0.15, "keywords_in_context": 0.20, "format": 0.10}
TOOL_VERBS = ("ized", "ised", "ization", "isation", "ify")
#: Endings that turn a name into another word.
DERIVATIONS = ("ization", "isation", "izing", "ising", "ized", "ised", "ify", "ing", "ed")

#: Words that show a level, by the level that a posting asks for.
SENIORITY = {
    "intern": r"intern|co-?op",
    "entry": r"intern|junior|associate|assistant|entry",
    "mid": r"engineer|developer|analyst|scientist|designer",
    "senior": r"senior|sr\.?|lead|staff|principal",
    "staff": r"staff|principal|architect|distinguished",
    "lead": r"lead|manager|head|director|principal",
}

#: Tokens that look technical and are not.
NOT_A_TOOL = (
    "I A AN THE AND OR TO OF IN ON AT BY FOR US USA UK EU NY NYC CA SF LA TX WA DC MA IL PhD BS BA MS MBA GPA CV OK TODO AM PM EST PST UTC "
    "Q1 Q2 Q3 Q4 H1 H2 FY CEO CTO VP HR COVID ID OS PC IT QA"
).split()
#: Shapes of technical names: acronym, camel case, letters then digits, plus signs, sharp, dotted suffix.
TECHNICAL = r"^([A-Z]{2,}[0-9]*|[A-Z][a-z]+[A-Z][A-Za-z]*|[A-Za-z]+[0-9]+[A-Za-z0-9]*|[A-Za-z]+\+\+|[A-Za-z]+#|[A-Za-z]{2,}\.(js|py|net|io|ai|sh))$"
TOKEN = r"[A-Za-z][A-Za-z0-9.+#/&'-]*"

#: Openers that say nothing, the first person, and the bullet thresholds.
WEAK_OPENERS = (
    r"^\s*(responsible for|tasked with|duties included|helped (with|to)|assisted (with|in)|worked (on|with)|involved in|participated in|in charge of|my role|part of a team)\b"
)
FIRST_PERSON = r"(^|[^a-z])(i|me|my|mine|myself|we|our|us)($|[^a-z])"
MAX_BULLET_CHARS, MIN_QUANTIFIED = 240, 0.4

#: Letter rubric: opening formulas, addressees, word lists and bands.
DEAD_OPENINGS = (
    r"^\s*(i am writing (to|in|because|regarding)|i'?m writing (to|in|because|regarding)|"
    r"i (am|'m) (very |extremely |incredibly )?(excited|thrilled|delighted|pleased|eager) to (apply|submit|express)|"
    r"i would like to (apply|express|submit)|i wish to apply|please accept (this|my)|"
    r"as a (passionate|dedicated|highly motivated|results[- ]driven|detail[- ]oriented)|"
    r"with (great|keen|much) (interest|enthusiasm)|it is with (great|much)|re\s*:|subject\s*:|application for\b)"
)
EXCESS_WORDS = (
    "delve delving delves tapestry underscores underscoring showcasing meticulous meticulously intricate garnered realm pivotal multifaceted "
    "groundbreaking unparalleled transformative invaluable commendable noteworthy"
).split() + ["testament to", "navigate the complexities", "seamlessly integrate", "leveraging my"]
CLICHES = (
    "synergy", "synergies", "game-changer", "hit the ground running", "think outside the box", "wear many hats",
    "a proven track record of success", "cutting-edge solutions", "wealth of experience", "robust solutions", "unwavering commitment",
    "in today's fast-paced", "ever-evolving", "in the ever-changing", "i am confident that my skills", "align perfectly with",
    "aligns perfectly with", "i am particularly drawn to",
)
FLATTERY = (
    "industry leader", "leading provider", "world-class", "i have long admired", "i have always admired", "your innovative",
    "your impressive", "your renowned", "esteemed", "prestigious", "your amazing", "your incredible",
)
LETTER_WORDS, LETTER_PARAGRAPHS, MAX_I_SHARE = (200, 400), (3, 4), 0.75

#: Text-layer faults (code point ranges) and page layout faults.
LIGATURES, PRIVATE_USE = "[\ufb00-\ufb06]", "[\ue000-\uf8ff]"
SPACED_OUT = r"(^|[^A-Za-z])([A-Za-z] ){4,}[A-Za-z]($|[^A-Za-z])"
LAYOUT = {
    "table": r"<table\b",
    "flex": r"display\s*:\s*(inline-)?flex",
    "grid": r"display\s*:\s*(inline-)?grid",
    "float": r"float\s*:\s*(left|right)",
    "absolute": r"position\s*:\s*absolute",
    "image": r"<img\b|<svg\b",
    "columns": r"column-count\s*:",
}
#: Stop thresholds: target score, slack under the ceiling, least gain, events kept, attempts.
TARGET, SLACK, MIN_GAIN, EVENTS_KEPT = 80.0, 2.0, 1.5, 400
#: Chunking: characters of a chunk, least words of a paragraph; teaser length.
CHUNK_CHARS, PARAGRAPH_WORDS, TEASER_CHARS = 700, 8, 240

#: Section names that machines file content under.
STANDARD_HEADINGS = (
    "summary", "professional summary", "profile", "objective", "skills", "technical skills", "core skills", "experience", "work experience",
    "professional experience", "employment history", "projects", "personal projects", "technical projects", "education", "certifications",
    "licenses", "certifications and licenses", "publications", "awards", "volunteer experience",
)
#: Dates that machines read: a month by its full name and a year, alone or as a range.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_RANGE = rf"^({_MONTHS})\s+\d{{4}}\s*[-–—]\s*(({_MONTHS})\s+\d{{4}}|Present)$|^(({_MONTHS})\s+\d{{4}}|Present)$"
#: Addressees that say nobody was looked for.
DEAD_ADDRESSEES = r"to whom it may concern|dear sir(?: or madam)?|dear madam"
#: Least characters of a requirement that counts as restated, posting terms a letter is held against, and pages allowed.
ECHO_CHARS, POSTING_TERMS, MAX_PAGES = 25, 30, 1
