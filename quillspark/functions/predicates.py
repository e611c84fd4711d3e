"""Row classifiers: boolean column expressions.

Patterns follow Java's dialect.  A null text gives null, which filters treat as
false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and symbols.
SECTION_NAMES = ("abstract", "introduction", "background", "methods", "materials and methods", "results", "discussion", "results and discussion", "conclusion", "conclusions", "acknowledgements", "references", "bibliography", "keywords")
STOPWORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
REPORTING = "was|were|is|are|shows?|presents?|depicts?|illustrates?|gives?|represents?|indicates?|displays?|summari[sz]\\w*|can\\b|has\\b|have\\b|below\\b|above\\b|and\\b|&"
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La "
    "Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
DIATOMIC = ("H2", "N2", "O2", "F2", "Cl2", "Br2", "I2", "O3")
NOT_FORMULAS = ("I2C", "SI6", "PI3K", "V2I", "P2Y12", "HV3", "HN6", "UP2")
YEAR = r"\b(?:19|20)\d{2}\b"
DASH = "[-–—]"


def any_of(text: Column, *patterns: str) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


#: Parts of citations in tidied text: one kind of dash, no space around punctuation.
SPAN = r"\d{1,5}-\d{1,5}"
NOTATIONS = (rf"\b\d{{1,4}}\(\d{{1,4}}[a-z]?\)[:.,]?{SPAN}", rf"\bpp?\.?\s?{SPAN}", rf"{YEAR};\d{{1,4}}(?:\([\w./-]{{1,15}}\))?[:.,]{SPAN}")


#: What stands between the word and a DOI's number.
DOI_FORMS = (":", "[.]", "[.] ?org/", ": ?org/")


def tidied(text: Column) -> Column:
    """Dashes as hyphens, and no space around punctuation inside a citation."""
    return F.regexp_replace(F.translate(F.trim(text), "–—", "--"), r"\s*([():;,-])\s*", "$1")


def is_reference_block(text: Column) -> Column:
    """A bibliography entry: a numbered line with a year, a DOI, or volume and pages in a line of at most 400 characters."""
    size = F.length(F.trim(text))
    number = r"^\s*(?:\[\d{1,3}\]\.?|\[?\d{1,3}\.\]?)\s"
    named = F.contains(F.lower(text), F.lit("doi")) & any_of(F.lower(tidied(text)), *[rf"\bdoi ?{form} ?10[.]\d{{4}}" for form in DOI_FORMS])
    short = text.rlike(r"\d\s*[-–—]\s*\d") & any_of(tidied(text), *NOTATIONS)
    return (size >= 25) & ((text.rlike(number) & text.rlike(YEAR)) | named | ((size <= 400) & short))


SIGNALS = {"number": r"^\s*(?:[\[(]\d+[\])]|\d+[.)])", "quoted title": "[“”\"]", "volume": r"(?i)\bvol\.?\s*\d", "identifier": "(?i)doi", "more authors": r"(?i)\bet\s+al\b", "pages": r"(?i)\bpp?\.\s*\d"}


def is_reference_entry(text: Column) -> Column:
    """A year beside any of SIGNALS."""
    return text.rlike(YEAR) & any_of(text, *SIGNALS.values())


def is_citation_sentence(text: Column) -> Column:
    """A sentence that cites: a year with et al or four commas, or an address."""
    year = text.rlike(YEAR)
    return (year & (text.rlike(r"(?i)\bet\s+al\b") | (F.regexp_count(text, F.lit(",")) >= 4))) | text.rlike("(?i)doi\\.org|https://")


def folded_heading(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"^[\d.\s]+|[:.\-–—\s]+$", ""))


def is_heading(text: Column) -> Column:
    """A section name, or a short numbered line in title words without a final stop; a section's number has parts of two digits at most, unlike network addresses and card numbers."""
    t = F.trim(text)
    return folded_heading(t).isin(*SECTION_NAMES) | ((F.length(t) <= 80) & t.rlike(r"^\d{1,2}(\.\d{1,2})*\.?\s+[A-Z]") & ~t.rlike(r"[.;,]$"))


def is_author(token: Column) -> Column:
    """One name: two to four capitalised words or initials."""
    return F.trim(token).rlike(r"^[A-Z][\w'’.-]*(?:\s+[A-Z][\w'’.-]*){1,3}[\d*,†‡]*$")


def is_byline(text: Column) -> Column:
    """A line of author names only, split at commas, semicolons and `and`."""
    names = F.filter(F.split(F.trim(text), r"\s*(?:,|;|\band\b|&)\s*"), lambda x: F.trim(x) != "")
    return (F.length(text) < 300) & (F.size(names) >= 1) & F.forall(names, is_author)


def is_affiliation(text: Column) -> Column:
    return text.rlike(r"(?i)\b(university|institute|department|college|school|hospital|laborator(y|ies)|faculty)\b") & (F.length(text) < 300)


def caption_head(label: str) -> str:
    return rf"(?:{label}|{label[:3]})\s*\.?\s*"


def is_prose_at(text: Column, label: str) -> Column:
    """A sentence that opens like a caption: the label, its number, then a verb."""
    return text.rlike(rf"(?i)^\s*{caption_head(label)}(\d{{1,2}})\s*(?:{REPORTING})")


def is_caption(text: Column, label: str) -> Column:
    """A caption of the label (Figure or Table), not a sentence that opens like one."""
    return text.rlike(rf"(?i)^\s{{0,2}}{caption_head(label)}\d{{1,2}}") & ~is_prose_at(text, label)


def opens_a_statistic(before: Column, after: Column) -> Column:
    """A stop that opens a p-value: a comparison before it and digits behind it."""
    return after.rlike(r"^\d") & before.rlike(r"(?i)(?:[=<>≤≥]|\bthan|\bof|\bp)[\s ]*$")


def names_something(before: Column, number: Column, unit: Column) -> Column:
    """A number and unit that are part of a name: a decade of 1500 to 2099, or what hangs on a letter by a hyphen."""
    year = F.when(F.length(number) == 4, number.try_cast("int"))
    decade = (unit == "s") & F.coalesce(year.between(1500, 2099), F.lit(False))
    return decade | (F.endswith(before, F.lit("-")) & F.left(F.right(before, F.lit(2)), F.lit(1)).rlike("[A-Za-z]"))


#: Element symbols, each with a count from 2 to 12 or none; a symbol has one reading, since no symbol begins with a small letter.
FORMULA = "^(?:(?:" + "|".join(ELEMENTS) + ")(?:[2-9]|1[0-2])?)+$"


def is_formula(token: Column) -> Column:
    """Element symbols end to end with counts, two elements or more, or a diatomic gas; product codes such as ABC12 are none."""
    elements = F.array_distinct(F.regexp_extract_all(token, F.lit("[A-Z][a-z]?"), F.lit(0)))
    code = token.rlike(r"^[A-Z]{3,}\d+$") | token.isin(*NOT_FORMULAS)
    return token.rlike(r"\d") & token.rlike(FORMULA) & ~code & (token.isin(*DIATOMIC) | (F.size(elements) >= 2))


def orcid_ok(orcid: Column) -> Column:
    """The ISO 7064 mod 11-2 check digit of 16 digits, hyphens aside."""
    digits = F.upper(F.regexp_replace(orcid, "-", ""))
    total = F.aggregate(F.split(F.substring(digits, 1, 15), ""), F.lit(0), lambda a, d: (a + d.cast("int")) * 2)
    check = (F.lit(12) - total % 11) % 11
    return digits.rlike(r"^\d{15}[\dX]$") & (F.when(check == 10, "X").otherwise(check.cast("string")) == F.substring(digits, 16, 1))


def initials(phrase: Column) -> Column:
    """Upper-case first letters of the words, joining words left out; hyphens part words."""
    words = F.filter(F.split(phrase, r"[\s\-–—]+"), lambda w: (w != "") & ~F.lower(w).isin(*STOPWORDS))
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


def spells(phrase: Column, short: Column) -> Column:
    """The phrase's initials end in the short form (or what of it they can hold)."""
    have = initials(phrase)
    n = F.least(F.length(short), F.length(have))
    return (n > 0) & (F.right(have, n) == F.right(short, n))


def letters_in_order(phrase: Column, short: Column) -> Column:
    """The short form's letters occur in the phrase in their order."""
    return F.lower(phrase).rlike(F.concat_ws(".*", F.split(F.lower(short), "")))


def query_kind(text: Column) -> Column:
    """Reference, Caption or prose: what kind of paragraph a query sits on."""
    return F.when(is_reference_block(text), "Reference").when(is_caption(text, "Figure") | is_caption(text, "Table"), "Caption").otherwise("prose")
