"""Personal information in free text: found, typed and replaced by keyed pseudonyms that keep their format."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("person_name", "email", "phone", "id_number", "street_address")

# Common given names, titles and closings in the corpus languages.
GIVEN = (
    "Alice Anna Anton Amir Ana Bruno Carla Carlos Chiara Clara Claire Daniel David Diego Elena Elif Elsa Emil Emma Eva Farid Fatima Felix Frank "
    "Greta Hana Hannah Hans Henrik Hugo Igor Ines Ingrid Ivan James Jan Jane Jean John Jonas Jorge Jose Juan Julia Julien Karl Kate Klaus Lars Laura Lena "
    "Leo Lucas Lucia Luis Lukas Marc Marco Maria Marie Mark Marta Martin Mary Max Mei Michael Miguel Mohamed Nadia Nina Noah Olga Omar Oskar Pablo Paolo Paul "
    "Pedro Peter Petra Pierre Priya Rafael Robert Rosa Ruth Samir Sara Sarah Simon Sofia Sophie Stefan Susan Thomas Tomas Ursula Viktor Wei Yusuf"
).split()
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sr", "Sra", "Dra")
CAPTIONS = (
    "Operator:", "Name:", "From:", "Reader", "Donor name", "Approved by", "Thanks to", "read by", "handed over to", "second reader,", "Signed by", "signed by", "Contact:",
    "Gemessen von", "Medido por", "Mesures faites par", "Best,", "Regards,", "Gruß", "Cordialement,", "Saludos,", "Sincerely,",
)
# Words with a capital that are no surname after a given name, and no surname before a comma.
ORDINARY = set(
    "A About Across Address Adresse After All Alle An Anschrift As At Auf Ausweisnummer Barcode Baseline Best Bitte Bench Briefly By Call Catalogue Censored Clone Colleagues Conclusion Contact Contents Cross "
    "Curves Dear Decisions Der Des Die Documento Donor El Endotoxin Enviar Envoyer Expression Falta Fab File Fitting Fold For From Fragen Für Gemessen Gruß Half He Held Hello Hi However Il Im In Kinetic Known La Lane Las Le Les "
    "Library Light Loading Mail Materials Measured Medido Merci Mesures Missing Mr Mrs Ms Nach Name National No Nous Of On Off Operator Order Overall Passport Pieza Pièce Please Pooling Procedure Purity Raw Reader Readout "
    "Reagent Regards Replicates Return Row Rows Sample Samples Saludos See Sent Setup She Ship Sincerely Social Software Someone Spearman Splits Summary Tel Temperature Thanks The They This Those Titration To Two Values Versand "
    "Answer Compare Consider Credit Decide Define Describe Discuss Explain Find Give Given How If Is It Let List Only Reject State Suppose True What When Where Which Who Why "
    "Wavelengths We Well Wells With Within You Your Wir Un Una Los Se".split()
)

# What follows a person's name, what comes before one, and nouns that make a name that of a body or place.
ACTS = (
    "signed asked said says wrote reviewed measured confirmed approved repeated noted noticed reported found joined ran prepared called emailed requested sent received took gave "
    "read checked entered left agreed disagreed suggested thinks explained presented owns leads works worked lives will must has had was is can may "
    "hat ist wird war prüfte bestätigte maß schrieb sagte a est était demande signe écrit ha fue es firmó dijo escribió midió"
).split()
ACTED = (
    "by to from with contact cc dear thank thanks colleague colleagues operator reader analyst technician scientist author donor patient doctor professor nurse supervisor "
    "von par por mit avec con frau herr kollege kollegin madame monsieur señor señora name"
).split()
BODIES = (
    "institute institut instituto university universität université college school hospital klinik clinic centre center foundation society laboratory laboratories lab labs inc ltd gmbh corp company "
    "street road lane avenue court drive square buffer medium assay kit method test plate library antibody protein award prize lecture library street building hall park bridge street church museum"
).split()

_CAP = r"(?:[OD]['’])?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
_SURNAME = rf"(?:(?:van|von|de|del|der|di|da)\s(?:der\s|la\s)?)?{_CAP}(?:-{_CAP})*"
_EDGE = r"(?<![\w@.+-])"
_INITIAL = r"[A-Z]\."
_OPEN = r"(?![\w@]|\.\w)"
# Every name holds a capital letter: words with one are found in a single scan, and the patterns tried only there.
CAPITAL = re.compile(rf"{_EDGE}[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]+|\.)")
FORWARD = re.compile(rf"(?P<first>{_CAP})(?:-{_CAP})?(?:[ \n]{_INITIAL})*[ \n](?P<last>{_SURNAME})(?![\w@:]|\.\w)")
SURNAME_LEFT = re.compile(rf"{_EDGE}(?P<last>{_SURNAME})$")
GIVEN_RIGHT = re.compile(rf"{_CAP}(?:[ \n]{_INITIAL}(?!\w))*(?![\w@-])")
INITIALS = re.compile(rf"(?:{_INITIAL}[ \n]?)+(?<=[ \n])(?P<last>{_SURNAME})(?![\w@:]|\.\w)")
TITLED = re.compile(rf"(?:{'|'.join(TITLES)})\.?[ \n]+(?P<name>(?:{_CAP}[ \n])?(?:{_INITIAL}[ \n])*(?P<last>{_SURNAME}))(?![\w@:]|\.\w)")
CAPTION = re.compile("|".join(map(re.escape, CAPTIONS)))
CAPTIONED = re.compile(rf"\s+(?P<name>{_CAP}(?:[ \n]{_INITIAL})*[ \n](?P<last>{_SURNAME})|(?P<last2>{_SURNAME}),[ ]{_CAP}(?=[\s.,;)<|]))(?![\w@:]|\.\w)")
LISTED = re.compile(r"\s*(?:[|,(<]\s*)+(?:\+|\(?\d{3}|0\d|[\w.+-]+\s?(?:@|[\[(]?\bat\b))")
# Names of no listed given name: both words on one line, none ordinary, and what stands around them speaks of a person.
PLAIN = re.compile(rf"(?P<first>{_CAP})(?:-{_CAP})?(?:[ ]{_INITIAL})*[ ](?P<last>{_SURNAME}){_OPEN}")
_ACTS = re.compile(rf"(?:['’]s?\b|\s(?:{'|'.join(ACTS)})\b)")
_ACTED = re.compile(rf"(?:\b(?:{'|'.join(ACTED)})\s)$", re.IGNORECASE)
_NO_PERSON = re.compile(rf"[\s-](?:{'|'.join(BODIES)})\b", re.IGNORECASE)
_AFTER_INITIALS = re.compile(r"[ \n]*(?:[|,(<.;]|and\b|et\b|und\b|y\b|hat\b|a\b|firmó|asked|signed|for\b|in\b|must|'|’|[A-ZÀ-Þ+0-9\n]|$)")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s*[\[({]\s*(?:dot|DOT|\.)\s*[\])}]\s*|\s+(?:dot|DOT)\s+)"
# An email is read outwards from its at: the local part to the left, the domain to the right.
AT = re.compile(r"@|[\s\[({][aA][tT][\s\])}]")
_LEFT = re.compile(r"(?<![\w.+%-])[A-Za-z0-9_](?:[\w.+%-]*[\w+%-])?(?P<gap>\s*[\[({]\s*|\s*)$", re.ASCII)
_RIGHT = {
    "bracketed": re.compile(rf"\s*[\])}}]\s*{_LABEL}(?:{_DOT}{_LABEL})+"),
    "sign": re.compile(rf"\s?{_LABEL}(?:{_DOT}{_LABEL})+"),
    "spelled": re.compile(rf"\s+{_LABEL}(?:\s+(?:dot|DOT)\s+{_LABEL})+"),
}
# Runs of seven characters of a number or more; phones and identity numbers are looked for in and around them.
DIGITS = re.compile(r"[+(]?\d[\d ()./\n-]{5,}")
PHONE = re.compile(
    r"(?<![\w+/.-])(?:"
    r"(?:\+|00)33[ \n]?(?:\(0\)[ \n]?)?\d(?:[ .\n]?\d\d){4}"
    r"|\+1[ .\n-]\(?\d{3}\)?[ .\n-]\d{3}[ .\n-]\d{4}"
    r"|(?:\+|00)\d{2,3}[ \n]\d{2,5}(?:[ \n]\d{3,6}){1,2}"
    r"|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}"
    r"|0\d{2,4}/\d{3,8}(?:-\d{1,5})?"
    r"|0\d{2,4}[ \n]\d{3,4}[ \n]\d{3,4}"
    r"|0\d(?:[ .]\d\d){4}"
    r"|\d{3}-\d{4}"
    r"|(?<!\))\(\d{3}\)[ \n]?\d{3}-\d{4}"
    r")(?![\w/-]|\.\d)"
)
_DATE_DIGITS = r"(?:18|19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
ID_NUMBER = re.compile(rf"(?<![\w.+/-])(?:\d{{3}}([- \n])\d{{2}}(?:\1|[ \n])\d{{4}}|[A-Z]{{2}}[ \n]?\d\d[ \n]?\d\d[ \n]?\d\d[ \n]?[A-D]|\d{{6}}{_DATE_DIGITS}\d{{3}}[\dXx]|[A-Z]\d{{8}})(?![\w/-]|\.\d)")
# What a code stands for when one of these words comes right before it.
NOT_PERSONAL = re.compile(r"(?:lot|lots|batch|charge|lote|order|orders|record|records|barcode|barcodes|catalogue|catalog|cat|sku|serial|build|version|clone|plate|sample|chip|part|article|invoice|reagent|reference|ref)(?:\s+(?:no|nr|number|code|id))?[.:#]*\s*$", re.IGNORECASE)
# A number that its own check does not prove is a person's only under such a caption.
PERSONAL = re.compile(r"(?:\bid\b|\bids\b|identi|ident\b|national|social|security|passport|passeport|pasaporte|ausweis|pass\b|personal|tax|insurance|nino|ssn|dni|nie|holder)[^\n.]{0,24}\s?$|(?:\bid|no\.?|number)[=:#]?\s*$", re.IGNORECASE)
_STREET = r"(?:Street|St\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Avenue|Ave\b\.?|Court|Ct\b\.?|Drive|Boulevard|Blvd\b\.?|Square|Terrace|Crescent|Close|Way|Place)"
NUMBERED = re.compile(
    rf"(?<![\w.,/+-])\d{{1,5}}[a-z]?(?:[ \n](?:bis|ter))?,?[ \n](?:(?:{_CAP}[ \n]){{1,3}}{_STREET}(?!\w)(?![ \n]\d+ shows)"
    r"|(?:rue|avenue|boulevard|chemin|place|quai|impasse|allée|cours)[ \n](?:(?:de|des|du|la|le|les|d')[ \n']?){0,3}[A-ZÀ-Þ][\wà-ÿ'-]+)"
)
_ENDINGS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "damm")
COMPOUND = re.compile(rf"(?:{'|'.join(map(re.escape, _ENDINGS))})[ \n]\d{{1,4}}[a-z]?(?!\w)")
_COMPOUND_LEFT = re.compile(rf"{_EDGE}[A-ZÄÖÜ][\wäöüß-]*$")
_LEADS = ("Calle", "Avenida", "Plaza", "Paseo", "Camino", "Carrera", "Ronda")
LEADING = re.compile(rf"(?<!\w)(?:{'|'.join(_LEADS)})[ \n](?:(?:de|del|la|las|los)[ \n]){{0,2}}[A-ZÀ-Þ][\wà-ÿ'-]+(?:[ \n][A-ZÀ-Þ][\wà-ÿ'-]+)*,?[ \n]\d{{1,4}}")
BIRTH = re.compile(r"(?i:\b(?:born|date of birth|birth date|dob|geboren am|geburtsdatum|née? le|date de naissance|fecha de nacimiento|nacid[oa] el))(?:\s+on)?[:\s]+(?P<date>(?P<y>(?:18|19|20)\d\d)-(?P<m>0[1-9]|1[0-2])-(?P<d>0[1-9]|[12]\d|3[01]))(?!\d)")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    for m in AT.finditer(text):
        sign = m.group() == "@"
        a, b = (m.start(), m.end()) if sign else (m.start() + 1, m.end() - 1)
        left = _LEFT.search(text, max(0, a - 80), a)
        if not left:
            continue
        gap = left["gap"]
        if any(c in gap for c in "[({"):
            right = _RIGHT["bracketed"].match(text, b)
        elif sign:
            right = _RIGHT["sign"].match(text, b) if len(gap) < 2 else None
        else:
            right = _RIGHT["spelled"].match(text, b) if gap else None
        if right:
            yield left.start(), right.end()


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in NUMBERED.finditer(text):
        yield m.span()
    if any(w in text for w in _LEADS):
        for m in LEADING.finditer(text):
            yield m.span()
    if any(w in text for w in _ENDINGS):
        for m in COMPOUND.finditer(text):
            left = _COMPOUND_LEFT.search(text, max(0, m.start() - 60), m.start())
            if left:
                yield left.start(), m.end()


_CHECKS = "10X98765432"
_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)


def _check_digit(body: str) -> str:
    return _CHECKS[sum(int(c) * w for c, w in zip(body, _WEIGHTS, strict=True)) % 11]


def _day(number: str) -> datetime.date | None:
    """The day that an 18-character number holds, None where it is none of the calendar."""
    try:
        return datetime.date(int(number[6:10]), int(number[10:12]), int(number[12:14]))
    except ValueError:
        return None


def proven(number: str) -> bool:
    """Whether an 18-character number holds a day of the calendar and its own check digit."""
    return _day(number) is not None and _check_digit(number[:17]) == number[17].upper()


def _valid_id(text: str, m: re.Match) -> bool:
    """Area, group and date rules of the format; what no check digit proves needs a caption that speaks of a person."""
    number = re.sub(r"\s", "", m.group())
    if m.group(1) and (number[:3] in ("000", "666") or number[-4:] == "0000"):
        return False
    if len(number) == 18 and proven(number):
        return True
    return bool(PERSONAL.search(text, max(0, m.start() - 40), m.start()))


def _ordinary(last: str) -> bool:
    return last.split("-")[0].strip() in ORDINARY or last in _GIVEN or last.lower() in _BODIES


_GIVEN, _TITLED, _BODIES = frozenset(GIVEN), frozenset(TITLES), frozenset(BODIES)


def _names(text: str) -> Iterator[tuple[int, int]]:
    """Spans of names, those that are surest first."""
    caps = [m.span() for m in CAPITAL.finditer(text)]
    words = [text[a:b] for a, b in caps]
    for (a, _), word in zip(caps, words, strict=True):
        if word in _GIVEN and a > 1 and text[a - 2] == "," and text[a - 1] in " \n":
            left, right = SURNAME_LEFT.search(text, max(0, a - 66), a - 2), GIVEN_RIGHT.match(text, a)
            if left and right and not _ordinary(left["last"]):
                yield left.start(), right.end()
    for (a, _), word in zip(caps, words, strict=True):
        if word.split("-")[0] in _GIVEN and (m := FORWARD.match(text, a)) and m["first"] in _GIVEN and not _ordinary(m["last"]) and not _NO_PERSON.match(text, m.end()):
            yield m.span()
    for (a, _), word in zip(caps, words, strict=True):
        if word.rstrip(".") in _TITLED and (m := TITLED.match(text, a)) and not _ordinary(m["last"]):
            yield _named(m)
    for c in CAPTION.finditer(text):
        m = CAPTIONED.match(text, c.end())
        if m and not _ordinary(m["last"] or m["last2"]):
            span = _named(m)
            if span:
                yield span
    for (a, b), word in zip(caps, words, strict=True):
        if len(word) == 2 and word[1] == ".":
            if (m := INITIALS.match(text, a)) and not _ordinary(m["last"]) and _AFTER_INITIALS.match(text, m.end()):
                yield m.span()
        elif (m := FORWARD.match(text, a)) and not _ordinary(m["last"]):
            plain = m["first"] not in ORDINARY
            if LISTED.match(text, m.end()):
                if plain:
                    yield m.span()
            elif plain and PLAIN.match(text, a) and not _NO_PERSON.match(text, m.end()) and (_ACTS.match(text, m.end()) or _ACTED.search(text, max(0, a - 24), a)):
                yield m.span()


def _named(m: re.Match) -> tuple[int, int]:
    """The span of the name, or of its surname where an ordinary word came before it."""
    if m["name"].split()[0].split("-")[0] in ORDINARY:
        return (m.start("last"), m.end()) if m["last"] else ()
    return m.start("name"), m.end()


def find_personal(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each occurrence in a text, in order, none overlapping another.

    Emails come first, so that names inside them are not taken; then identity numbers, phones, addresses and names.
    Patterns are tried only where a scan for digits, capitals or an at leads them.
    """
    out: list[tuple[str, int, int]] = []
    taken = bytearray(len(text))

    def take(kind: str | None, a: int, b: int) -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\x01" * (b - a)
            if kind:
                out.append((kind, a, b))

    for a, b in _emails(text):
        take("email", a, b)
    runs = []
    for m in DIGITS.finditer(text):
        a, b = max(0, m.start() - 4), min(len(text), m.end() + 12)
        if runs and a <= runs[-1][1]:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    for pattern, kind in ((ID_NUMBER, "id_number"), (PHONE, "phone")):
        for a, b in runs:
            for m in pattern.finditer(text, a, b):
                coded = NOT_PERSONAL.search(text, max(0, m.start() - 30), m.start())
                if kind == "id_number":
                    take(None if coded or not _valid_id(text, m) else kind, *m.span())
                elif not coded:
                    take(kind, *m.span())
    for a, b in _addresses(text):
        take("street_address", a, b)
    for a, b in _names(text):
        take("person_name", a, b)
    return sorted(out, key=lambda x: x[1])


def feistel(value: int, size: int, key: bytes, rounds: int = 8) -> int:
    """A keyed permutation of range(size): a balanced Feistel network over two halves, walked until it falls back into range."""
    if size < 2:
        return value
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(rounds):
            mixed = hmac.digest(key, b"%d|%d|%d" % (r, size, right), hashlib.sha256)
            left, right = right, left ^ (int.from_bytes(mixed[:8], "big") & mask)
        value = left << half | right
        if value < size:
            return value


_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 55_000


def permuted_digits(text: str, key: bytes, keep: int = 0) -> str:
    """The text with the digits after the first `keep` permuted as one number of their length; everything else stays."""
    digits = [c for c in text if c.isdigit()][keep:]
    if not digits:
        return text
    new = iter(str(feistel(int("".join(digits)), 10 ** len(digits), key + b"digits")).zfill(len(digits)))
    seen, out = 0, []
    for c in text:
        if c.isdigit():
            seen += 1
            c = next(new) if seen > keep else c
        out.append(c)
    return "".join(out)


def _permuted_day(day: datetime.date, key: bytes) -> datetime.date | None:
    n = day.toordinal() - _FIRST_DAY
    return datetime.date.fromordinal(_FIRST_DAY + feistel(n, _DAYS, key + b"day")) if 0 <= n < _DAYS else None


def pseudonym(kind: str, text: str, key: bytes) -> str:
    """The placeholder of an occurrence: numbers and dates are permuted within their format, other text becomes a keyed tag.

    Spaces and hyphens of a number are no part of what is permuted, so one number in two spellings stays linked. A number
    that its check digit proves becomes another proven one, an unproven one stays unproven; days are permuted among days.
    """
    text = " ".join(text.split())
    if kind == "date":
        day = _permuted_day(datetime.date.fromisoformat(text), key)
        return f"[DATE {day or permuted_digits(text, key + b'date')}]"
    if kind == "id_number" and len(text) == 18 and text[:17].isdigit() and (old := _day(text)) and (day := _permuted_day(old, key)):
        body = permuted_digits(text[:6], key + b"area") + day.strftime("%Y%m%d") + permuted_digits(text[14:17], key + b"order")
        was, now = _check_digit(text[:17]), _check_digit(body)
        wrong = [c for c in _CHECKS if c != now]
        return f"[ID_NUMBER {body}{now if text[17].upper() == was else wrong[[c for c in _CHECKS if c != was].index(text[17].upper())]}]"
    if kind in ("phone", "id_number"):
        return f"[{kind.upper()} {permuted_digits(text, key + kind.encode(), keep=len(re.match(r'\+?(\d{0,2})', text).group(1)) if text.startswith('+') else 0)}]"
    tag = hmac.digest(key, f"{kind}|{text.lower()}".encode(), hashlib.sha256).hex()[:32]
    return f"[{kind.upper()} {tag}]"


def _birth_dates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans with those of dates under a caption of birth that overlap none of them."""
    found = []
    for m in BIRTH.finditer(text):
        try:
            datetime.date(int(m["y"]), int(m["m"]), int(m["d"]))
        except ValueError:
            continue
        a, b = m.span("date")
        if not any(a < y and x < b for _, x, y in spans):
            found.append(("date", a, b))
    return sorted([*spans, *found], key=lambda x: x[1])


def personal_spans(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(doc, pii_type, start_pos, length): each occurrence, start_pos the characters before it.

    Null and empty texts hold none; repeated documents give their rows again. An empty table gives no rows.
    """
    texts = docs.where(docs[text_col].isNotNull()).select(docs[doc_col].alias("doc"), docs[text_col].alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, kind, a, b - a) for doc, text in zip(batch["doc"], batch["text"], strict=True) for kind, a, b in find_personal(text)]
            yield pd.DataFrame(rows, columns=["doc", "pii_type", "start_pos", "length"])

    return texts.mapInPandas(run, f"doc {texts.schema['doc'].dataType.simpleString()}, pii_type string, start_pos int, length int")


def without_personal(docs: DataFrame, doc_col: str, text_col: str, key: bytes) -> DataFrame:
    """(doc, text, replaced): every text with typed placeholders for its personal information, the rest unchanged.

    Equal values get equal placeholders in all documents under one key: a Feistel network permutes phone and identity
    numbers and dates of birth within their format; tags of names and addresses have 128 bits. Other dates stay, as the rest
    of the text. Null texts stay null with 0 replaced.
    """
    texts = docs.select(docs[doc_col].alias("doc"), docs[text_col].alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                spans = _birth_dates(text, find_personal(text)) if text else []
                parts, end = [], 0
                for kind, a, b in spans:
                    parts += [text[end:a], pseudonym(kind, text[a:b], key)]
                    end = b
                rows.append((doc, "".join([*parts, text[end:]]) if spans else text, len(spans)))
            yield pd.DataFrame(rows, columns=["doc", "text", "replaced"])

    return texts.mapInPandas(run, f"doc {texts.schema['doc'].dataType.simpleString()}, text string, replaced int")
