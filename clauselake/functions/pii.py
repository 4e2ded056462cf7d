"""Personal data: checksums, counts by kind, and what a page's counts mean.  Built-in expressions only; a null text is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Kinds in their order, and what they stand for.
KINDS = ("email", "contact_email", "payment_card", "national_id", "iban", "dob", "phone", "address", "account_marker")
STRONG = ("email", "payment_card", "national_id", "iban", "dob")
CONTACT = ("contact_email", "phone", "address")
#: Labels of mailbox providers for private persons.
CONSUMER_MAIL = (
    "gmail", "googlemail", "yahoo", "ymail", "rocketmail", "hotmail", "outlook", "live", "msn", "icloud", "aol", "proton",
    "protonmail", "gmx", "yandex", "qq", "163", "126", "sina", "sohu", "foxmail", "naver", "daum", "zoho", "fastmail",
    "tutanota", "comcast", "verizon", "sbcglobal", "btinternet", "t-online", "libero", "mail",
)
#: The patterns of each kind, and the weights of the resident number's check digit.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PLACEHOLDER = r"(^|\.)(example\.(com|org|net)|example|test|invalid|localhost)$"
CARD = r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])"
HKID, CN_ID, SSN = r"\b[A-Z]{1,2}\d{6}\(?[0-9A]\)?(?!\w)", r"\b\d{17}[\dXx]\b", r"\b\d{3}-\d{2}-\d{4}\b"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4}){3,9}\b"
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DOB = (
    r"(?i)\b(?:date of birth|d\.?o\.?b\.?|birth ?date|born(?: on)?)\b[\s:\u2013-]*"
    rf"(?:\d{{1,4}}[/.-]\d{{1,2}}[/.-]\d{{1,4}}|{MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{MONTH}\s+\d{{4}})"
)
PHONE = r"(?<![\w@./])\+?\d[\d\s().-]{6,17}\d(?![\w@])"
STREET = r"\b\d{1,5}\s+(?:[A-Z][\w.'-]*\s+){1,4}(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl)\b\.?"
FLAT = r"(?i)\b(?:Flat|Room|Rm|Unit|Suite)\s+\w+[,\s].{0,80}?(?:Road|Street|Rd|St|Building|Tower|Court|Avenue|Lane)\b"
MARKERS = (
    r"(?i)\b(?:signed|logged)[ -]in as\b",
    r"\b(?:[Ww]elcome back|[Hh]ello|[Hh]i),?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b",
    r"(?i)\b(?:my (?:account|profile|orders?|wallet|payment methods?)|order history|saved addresses|billing details)\b",
    r"(?i)\b(?:account|customer|member(?:ship)?|policy|order|reference) (?:number|no\.?|id|#)\s*[:#]?\s*[A-Z0-9-]{4,}",
)
ACCOUNT_PATH = r"(?i)(^|/)(account|accounts|profile|settings|orders?|order-history|billing|payments?|wallet|inbox|messages|dashboard|portal|statements?|my|me|member|checkout)(/|$|[-_.])"
POLICY_PATH = r"(?i)(terms|tos|privacy|legal|policy|policies|conditions|cookie|eula|agreement|user-agreement)"
CN_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _digits(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    """13 to 19 digits that pass the Luhn test."""
    return digits.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", F.when(digits.rlike(r"^\d+$"), digits).otherwise("1"))


def hkid_valid(raw: Column) -> Column:
    """One or two letters, six digits and a check digit (0-9 or A), maybe in brackets."""
    shape = r"^([A-Z]{1,2})(\d{6})\(?([0-9A])\)?$"

    def check(s: Column) -> Column:
        letters, digits, last = (F.regexp_extract(s, shape, i) for i in (1, 2, 3))
        first = F.when(F.length(letters) == 2, F.ascii(letters) - 55).otherwise(36)
        second = F.ascii(F.substring(letters, -1, 1)) - 55
        total = first * 9 + second * 8 + _sum(F.transform(_digits(digits), lambda d, i: d.cast("int") * (F.lit(7) - i)))
        want = F.pmod(F.lit(11) - total % 11, F.lit(11))
        return s.rlike(shape) & (F.when(want == 10, "A").otherwise(want.cast("string")) == last)

    return let(F.upper(raw), check)


def cn_id_valid(raw: Column) -> Column:
    """18 characters, weighted mod 11."""
    weights = F.array(*[F.lit(w) for w in CN_WEIGHTS])
    body = F.when(raw.rlike(r"^\d{17}[\dXx]$"), F.substring(raw, 1, 17)).otherwise("0")
    total = _sum(F.transform(_digits(body), lambda d, i: d.cast("int") * F.get(weights, i)))
    return raw.rlike(r"^\d{17}[\dXx]$") & (F.substring(F.lit("10X98765432"), total % 11 + 1, F.lit(1)) == F.upper(F.substring(raw, 18, 1)))


def iban_valid(raw: Column) -> Column:
    """Mod 97 of the rearranged number, letters as two digits."""

    def check(s: Column) -> Column:
        turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
        value = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        rest = F.aggregate(_digits(turned), F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97))
        return s.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (rest == 1)

    return let(F.upper(F.regexp_replace(raw, r"\s+", "")), check)


def emails(text: Column) -> Column:
    """email, contact_email: addresses at consumer providers, and others; placeholders don't count."""
    domains = F.transform(_all(text, EMAIL), lambda m: F.lower(F.substring_index(m, "@", -1)))
    domains = F.filter(domains, lambda d: ~d.rlike(PLACEHOLDER))

    def personal(d: Column) -> Column:
        labels = F.split(d, r"\.")
        n = F.size(labels)
        second = F.element_at(labels, -2)
        label = F.when((n > 2) & second.isin("co", "com", "org", "ne", "or", "ac"), F.try_element_at(labels, F.lit(-3))).otherwise(second)
        # `mail` is a provider as mail.com alone: elsewhere it is a company's own server.
        return label.isin(*CONSUMER_MAIL) & ((label != "mail") | (n == 2))

    return let(F.transform(domains, personal), lambda p: F.struct(F.size(F.filter(p, lambda x: x)).alias("email"), F.size(F.filter(p, lambda x: ~x)).alias("contact_email")))


def cards(text: Column) -> Column:
    return F.size(F.filter(_all(text, CARD), lambda m: luhn_valid(F.regexp_replace(m, "[ -]", ""))))


def national_ids(text: Column) -> Column:
    ssn = lambda m: ~m.rlike(r"^(000|666|9)|-00-|-0000$")
    return F.size(F.filter(_all(text, HKID), hkid_valid)) + F.size(F.filter(_all(text, CN_ID), cn_id_valid)) + F.size(F.filter(_all(text, SSN), ssn))


def ibans(text: Column) -> Column:
    """Candidates of which some first groups pass."""
    heads = lambda g: F.transform(F.sequence(F.lit(1), F.size(g)), lambda k: F.array_join(F.slice(g, F.lit(1), k), ""))
    return F.size(F.filter(_all(text, IBAN), lambda m: F.exists(let(F.split(m, " "), heads), iban_valid)))


def phones(text: Column) -> Column:
    def counts(m: Column) -> Column:
        digits = F.regexp_replace(m, r"\D", "")
        n = F.length(digits)
        return (n >= 8) & (n <= 15) & ~m.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~((n >= 13) & luhn_valid(digits)) & (m.startswith("+") | m.rlike(r"[\s().-]"))

    return F.size(F.filter(_all(text, PHONE), counts))


def counts(text: Column) -> Column:
    """How many of each kind a text holds, as a struct in the order of KINDS.  The values themselves are not kept."""
    text = F.coalesce(text, F.lit(""))
    found = lambda p: F.regexp_count(text, F.lit(p))
    parts = {
        "payment_card": cards(text),
        "national_id": national_ids(text),
        "iban": ibans(text),
        "dob": found(DOB),
        "phone": phones(text),
        "address": found(STREET) + found(FLAT),
        "account_marker": sum((found(p) for p in MARKERS), F.lit(0)),
    }
    return let(emails(text), lambda e: F.struct(e["email"].alias("email"), e["contact_email"].alias("contact_email"), *[v.cast("int").alias(k) for k, v in parts.items()]))


def findings(counted: Column) -> Column:
    """kind and count of those found, in order."""
    return F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), counted[k].alias("count")) for k in KINDS]), lambda x: x["count"] > 0)


def passage_has_pii(counted: Column) -> Column:
    """Any strong kind."""
    return sum((counted[k] for k in STRONG), F.lit(0)) > 0


def assess(counted: Column, path: Column) -> Column:
    """personal, score of a page: strong kinds count two; contact data (not on policy pages), markers and account paths are hints."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    strong = sum((one(counted[k] > 0) for k in STRONG), F.lit(0))
    account, policy = F.coalesce(path.rlike(ACCOUNT_PATH), F.lit(False)), F.coalesce(path.rlike(POLICY_PATH), F.lit(False))
    contact = sum((counted[k] for k in CONTACT), F.lit(0)) > 0
    hints = one(counted["account_marker"] > 0) + one(account) + one(contact & ~(policy & ~account))
    return F.struct(((strong >= 1) | (hints >= 2)).alias("personal"), (strong * 2 + hints).alias("score"))
