"""Personal data replaced by surrogates: keyed, of the same kind and format, distinct where the originals are.

Found are e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, card numbers, social security numbers, IBANs,
quoted secrets, dates of birth, passport numbers, street addresses, and names of persons: a known given name and the
capitalised word after it, or one or two capitalised words after a title or words such as "my name is". Where a document has a
full name, its given name and its surname alone are mentions of that person too, of the last one named so before them. Spellings of one
entity, such as other separators or case, have one normal form, and so one surrogate in all documents; each place shows
it in its own spelling. A surrogate is drawn from an HMAC of kind and normal form: digits for digits, letters for letters
of the same case and script, country codes, top-level domains, separators and the validity of check digits kept, and days that
the calendar has.

A person is a given name and a surname, and each has a surrogate of its own, whatever the title and wherever it stands: so a
full name, its parts, and "Dr. Zhang" in another document agree, and different names stay different. Given names get one of the same
gender and script: the gender that is known, or that most titles in the corpus tell, or a drawn one.

All distinct entities of the corpus are checked, across kinds: where two share a surrogate, or a surrogate is an original of the
corpus, all but the first draw again, until none do. With each attempt there is more to draw from (more names, letters or digits, years
farther off), so it ends; after ROUNDS attempts it is an error that names the kinds. The check and the mapping are joins; nothing but single documents
and entities is held in memory.

Nulls: a null text stays null, and a null doc_id is an id like others. Repeated rows get the same surrogates. Other columns stay. No rows
give no rows.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_frequent, written

# Given names by script and gender, surnames by script (the Cyrillic ones with a feminine form).
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Sofia Emma Olivia Julia Sarah Elena Clara Alice Hannah Marie Lucia Carmen Ingrid Greta Nora Chloe Camille".split(),
    ("latin", "m"): "James John Robert Michael David Thomas Daniel Peter Paul Martin Lucas Pierre Hans Carlos Miguel Antoine Erik Simon Oscar Felix".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Дарья Вера".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Павел Олег".split(),
}
SURNAMES = {
    ("latin", "f"): "Berg Novak Silva Moreau Keller Lindholm Hart Vance Ortega Marsh Dubois Fischer Romero Whitlock Sandoval Becker Laurent Castel Thorne Engel".split(),
    ("cyrillic", "m"): "Иванов Петров Сидоров Кузнецов Смирнов Орлов Волков Соколов Лебедев Морозов".split(),
}
STREETS = "Linden Oak Maple Cedar Garden Mill Station Church Park River Meadow Hill Spring Forest Castle Market".split()
SURNAMES[("latin", "m")] = SURNAMES[("latin", "f")]
SURNAMES[("cyrillic", "f")] = [s + "а" for s in SURNAMES[("cyrillic", "m")]]
#: Attempts at a surrogate, after which a kind has too few.
ROUNDS = 48
# What names are made up of once the lists have too few.
ONSETS, VOWELS = {"latin": "b d f g h k l m n p r s t v z br dr fl gr kl st tr".split(), "cyrillic": "б в г д з к л м н п р с т ф бр гр др ст тр".split()}, {"latin": "a e i o u".split(), "cyrillic": "а е и о у".split()}
GENDER = {name.lower(): who for who, names in GIVEN.items() for name in names}

_NUMBER = re.compile(r"[+(0-9][0-9 ().\-]{5,}[0-9]")
_CARD = re.compile(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}")
_PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}")
_IP = re.compile(r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_NUMBERS = (("card", _CARD), ("ip", _IP), ("ssn", _SSN), ("phone", _PHONE))
_LOCAL, _DOMAIN = re.compile(r"[\w.+\-]*[\w+\-]$"), re.compile(r"[\w\-]+(?:\.[\w\-]+)+")
_SECRET = re.compile(r"""(?:token|secret|password|passwd|api[_-]?key)\s*[=:]\s*["']([^"'\s]{6,})["']""", re.I)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_AFTER = re.compile(r" ([A-ZА-ЯЁÀ-ÖØ-Þ][\w'\-]+)")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_BORN = re.compile(r"\b(?:born(?: on)?|date of birth|dob|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)[:,]? {1,2}([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{4})(?![0-9])", re.I)
_PASSPORT = re.compile(r"\b(?:passport|reisepass|passeport|pasaporte)(?: (?:number|no\.?|nr\.?|n°|núm\.?))?:? ([A-Z]{0,2}[0-9]{6,9}|[A-Z0-9]{2}[0-9]{2}[A-Z0-9]{5})(?![A-Za-z0-9])", re.I)
_STREET = re.compile(r"(?<![\w-])(?:[0-9]{1,5} (?:[A-Z][a-z]+ ){1,2}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd)|[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|gasse) [0-9]{1,4})(?!\w)")
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'\-]+"
_TITLED = re.compile(rf"(?<!\w)(?:(Mr|Herr|Monsieur|Señor|Sr)|(Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra)|Dr|Prof)\.? ({_NAME}(?: {_NAME})?)")
_CALLED = re.compile(rf"\b(?:my name is|i am called|(?:full )?name:|signed by|best regards,|sincerely,|ich heiße|je m'appelle|me llamo|меня зовут)\s+({_NAME} {_NAME})", re.I)
# Country calling codes of one and of two digits; all others have three.
CALLING = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
_names = None


def _people():
    global _names
    if _names is None:
        import ahocorasick

        _names = ahocorasick.Automaton()
        for name in GENDER:
            for form in (name.capitalize(), name.upper()):
                _names.add_word(form, form)
        _names.make_automaton()
    return _names


def _before_others(text: str, hit: re.Match, end: int) -> re.Match:
    """A telephone number without the groups from where another number begins, if it is one without them."""
    for group in re.finditer(r"(?<=[ .\-])[0-9]+", hit[0]):
        at = hit.start() + group.start()
        shorter = _PHONE.fullmatch(text, hit.start(), at - 1)
        if shorter and sum(c.isdigit() for c in shorter[0]) >= 7:
            others = (pattern.match(text, at, end) for _, pattern in _NUMBERS)
            if any(o and not text[o.end() : o.end() + 1].isalnum() for o in others):
                return shorter
    return hit


def spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text, in order, none within another; a mention by one name
    alone has its person's kind with /given or /last."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        left, right = _LOCAL.search(text[max(0, at - 64) : at]), _DOMAIN.match(text, at + 1)
        if left and right:
            found.append((at - len(left[0]), right.end(), "email", text[at - len(left[0]) : right.end()].lower()))
        at = text.find("@", at + 1)
    for m in _NUMBER.finditer(text):
        begin = m.start()
        while begin < m.end():
            for kind, pattern in _NUMBERS:
                hit = pattern.match(text, begin, m.end())
                if hit and kind == "phone":
                    hit = _before_others(text, hit, m.end())
                if hit and not (begin and (text[begin - 1].isalnum() or text[begin - 1] in ".@")) and not text[hit.end() : hit.end() + 1].isalnum():
                    value = hit[0]
                    found.append((begin, hit.end(), kind, value if kind == "ip" else ("+" if value[0] == "+" else "") + re.sub(r"[^0-9]", "", value)))
                    begin = hit.end()
                    break
            else:
                begin += 1
    if '"' in text or "'" in text:
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in _SECRET.finditer(text)]
    found += [(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in _IBAN.finditer(text) if _mod97(m[0].replace(" ", "")) == 1]
    for pattern, kind in ((_BORN, "birth"), (_PASSPORT, "passport")):
        found += [(m.start(1), m.end(1), kind, m[1]) for m in pattern.finditer(text)]
    found += [(m.start(), m.end(), "street", m[0]) for m in _STREET.finditer(text)]
    if text.count(":") > 1:
        found += [(m.start(), m.end(), "ipv6", m[0].lower()) for m in _IPV6.finditer(text) if _is_ipv6(m[0])]
    found += _persons(text)
    kept, end = [], 0
    for s in sorted(found, key=lambda s: (s[0], -s[1])):
        if s[0] >= end:
            kept.append(s)
            end = s[1]
    return kept


def _is_ipv6(text: str) -> bool:
    try:
        return ipaddress.ip_address(text).version == 6 and sum(c.isalnum() for c in text) > 3
    except ValueError:
        return False


def _persons(text: str) -> list[tuple[int, int, str, str]]:
    """Full names, surnames after titles, and the mentions of persons by one of their names alone."""
    full: list[tuple[int, int, str, str]] = []
    for last, form in _people().iter(text):
        start = last - len(form) + 1
        after = _AFTER.match(text, last + 1)
        if after and not (start and text[start - 1].isalnum()):
            full.append((start, after.end(), "name", text[start : after.end()].lower()))
    alone: list[tuple[int, int, str, str]] = []
    starts = {s[0] for s in full}
    for m in _TITLED.finditer(text):
        if m.start(3) in starts:
            continue
        value = m[3].lower()
        if " " in value:
            full.append((m.start(3), m.end(3), "name", value))
        else:
            alone.append((m.start(3), m.end(3), "surname", value))
    starts = {s[0] for s in full}
    for m in _CALLED.finditer(text):
        words = m[1].split(" ")
        if m.start(1) not in starts and all(w[0].isupper() for w in words):
            full.append((m.start(1), m.end(1), "name", m[1].lower()))
    if not full:
        return alone
    persons: dict[str, list[tuple[int, str, str]]] = {}  # a name as written: where, and of whom
    for start, end, kind, value in sorted(full):
        for part, name in zip(("given", "last"), text[start:end].split(" ", 1), strict=True):
            persons.setdefault(name, []).append((start, f"{kind}/{part}", value))
    found, taken = list(full), sorted((s[0], s[1]) for s in full)
    for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(persons, key=len, reverse=True))) + r")(?!\w)", text):
        at = bisect.bisect_right(taken, (m.start(), len(text))) - 1
        if at < 0 or m.start() >= taken[at][1]:
            before = [p for p in persons[m[0]] if p[0] < m.start()]
            if before:
                found.append((m.start(), m.end(), *before[-1][1:]))
    mentions = {s[0] for s in found}
    return found + [s for s in alone if s[0] not in mentions]


def titled_genders(text: str) -> set[tuple[str, str]]:
    """(given name, gender) as titles before full names tell it."""
    return {(m[3].lower().partition(" ")[0], "m" if m[1] else "f") for m in _TITLED.finditer(text) if (m[1] or m[2]) and " " in m[3]}


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


class Draws:
    """Numbers drawn from an HMAC of some words under a key."""

    def __init__(self, key: bytes, *words: str):
        self.stream, self.key, self.words = b"", key, "\0".join(words).encode()
        self.blocks = 0

    def below(self, n: int) -> int:
        if len(self.stream) < 8:
            self.stream += hmac.new(self.key, self.blocks.to_bytes(4, "big") + self.words, hashlib.sha256).digest()
            self.blocks += 1
        taken, self.stream = self.stream[:8], self.stream[8:]
        return int.from_bytes(taken, "big") % n

    def like(self, text: str) -> str:
        """A digit for each digit, and a letter of the same case and script for each letter."""
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif "а" <= c.lower() <= "я":
                new = chr(ord("а") + self.below(32))
                out.append(new.upper() if c.isupper() else new)
            elif c.isalpha():
                new = chr(ord("a") + self.below(26))
                out.append(new.upper() if c.isupper() else new)
            else:
                out.append(c)
        return "".join(out)

    def hexadecimal(self, text: str) -> str:
        return "".join("0123456789abcdef"[self.below(16)] if c.isdigit() or c.islower() else "0123456789ABCDEF"[self.below(16)] for c in text)


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The normal form that stands for an entity's, at an attempt."""
    draws = Draws(key, kind, value, str(attempt))
    wider = attempt // 8  # few values have the format: it gives way
    if kind == "email":
        local, _, domain = value.rpartition("@")
        site, _, top = domain.rpartition(".")
        return f"{draws.like(local + 'x' * wider)}@{Draws(key, 'domain', domain, '0').like(site)}.{top}"
    if kind == "ip":
        if wider:
            return ".".join(str(1 + draws.below(254)) for _ in range(4))
        return ".".join(str((1 + draws.below(9), 10 + draws.below(90), 100 + draws.below(155))[len(str(int(x))) - 1]) for x in value.split("."))
    if kind == "card":
        body = draws.like(value[:-1])
        check = (10 - _luhn(body + "0")) % 10
        valid = _luhn(value) == 0
        return body + str(check if valid else (check + 1 + draws.below(9)) % 10)
    if kind == "phone":
        country = value[: 1 + next((n for n in (1, 2) if value[1 : 1 + n] in CALLING), 3)] if value[0] == "+" else ""
        return country + draws.like(value[len(country) :] + "0" * wider)
    if kind == "iban":
        body = draws.like(value[4:])
        return f"{value[:2]}{98 - _mod97(value[:2] + '00' + body):02d}{body}"
    if kind == "secret":
        value += "0" * wider
        return draws.hexadecimal(value) if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else draws.like(value)
    if kind == "ipv6":
        return re.sub("[0-9a-f]+", lambda m: f"{1 + draws.below(16 ** len(m[0]) - 1):x}", value)
    if kind == "birth":
        return _another_day(value, attempt, draws)
    if kind == "street":
        word = "-".join(STREETS[draws.below(len(STREETS))] for _ in range(1 + attempt // 4))
        number = draws.like(re.sub(r"[^0-9]", "", value) + "0" * (attempt // 8))
        number = number.lstrip("0") or "1"
        if value[0].isdigit():
            return f"{number} {word} {value.split()[-1]}"
        return f"{word}{re.search('straße|strasse|gasse', value)[0]} {number}"
    if kind.startswith("name"):
        given, _, last = value.partition(" ")
        return f"{surrogate('given' + kind[4:], given, attempt, key)} {surrogate('surname', last, attempt, key)}"
    if kind == "surname" or kind.startswith("given"):
        return _another_name(kind, value, attempt, draws).lower()
    return draws.like(value + "0" * wider if value[-1:].isdigit() else value + "x" * wider)


def _cyrillic(text: str) -> bool:
    return any("а" <= c <= "я" or c == "ё" for c in text.lower())


def _another_name(kind: str, value: str, attempt: int, draws: Draws) -> str:
    """A name of the lists at the first attempts, and then one made up of ever more syllables."""
    script = "cyrillic" if _cyrillic(value) else "latin"
    if kind == "surname":
        who = "f" if script == "cyrillic" and value.endswith(("а", "я")) else "m"
        names, ending = SURNAMES[script, who], {"latin": "er", "cyrillic": "ов" if who == "m" else "ова"}[script]
    else:
        who = GENDER.get(value, (script, kind[6:] or "fm"[draws.below(2)]))[1]
        names, ending = GIVEN[script, who], {"latin": "a" if who == "f" else "en", "cyrillic": "а" if who == "f" else "ан"}[script]
    if attempt < 4:
        return names[draws.below(len(names))]
    onsets, vowels = ONSETS[script], VOWELS[script]
    made = [onsets[draws.below(len(onsets))] + vowels[draws.below(len(vowels))] for _ in range(attempt // 4)]
    return "".join([*made, onsets[draws.below(len(onsets))], ending])


def _day(date: str) -> tuple[list[str], list[int]] | None:
    """The numbers of a date, and which of them are year, month and day, as the calendar has them; of month and day, where either may come
    first, the day does only if there is no such date otherwise or between points."""
    numbers = re.findall("[0-9]+", date)
    orders = [[0, 1, 2]] if len(numbers[0]) == 4 else [[2, 1, 0], [2, 0, 1]] if "." in date else [[2, 0, 1], [2, 1, 0]]
    for order in orders:
        try:
            datetime.date(*(int(numbers[i]) for i in order))
        except ValueError:
            continue
        return numbers, order
    return None


def _another_day(date: str, attempt: int, draws: Draws) -> str:
    """Another day of the calendar within six years, and of twice as many with each second attempt, with as many digits in each place. What was no day of
    the calendar is one then."""
    numbers, order = _day(date) or (re.findall("[0-9]+", date), [0, 1, 2] if len(re.match("[0-9]+", date)[0]) == 4 else [2, 0, 1])
    year, reach = min(max(int(numbers[order[0]]), 1000), 9999), 6 << min(attempt // 2, 10)
    first, last = datetime.date(max(1000, year - reach), 1, 1), datetime.date(min(9999, year + reach), 12, 31)
    while True:  # one in thirty days at least has the digits
        day = first + datetime.timedelta(draws.below((last - first).days + 1))
        new = dict(zip(order, (day.year, day.month, day.day), strict=True))
        shown = [str(new[i]) if len(n) == 1 else str(new[i]).zfill(len(n)) for i, n in enumerate(numbers)]
        if all(len(x) == len(n) for x, n in zip(shown, numbers, strict=True)):
            break
    parts = iter(shown)
    return re.sub("[0-9]+", lambda _: next(parts), date)


def spelt(kind: str, new: str, place: str) -> str:
    """A surrogate's normal form in the spelling of a place."""
    if kind in ("given", "surname") or kind.startswith("name"):
        return new.upper() if place.isupper() else re.sub(r"\w+", lambda m: m[0].capitalize(), new)
    if kind == "email":
        return new.upper() if place.isupper() else new
    if kind in ("ip", "ipv6", "secret", "birth", "street"):
        return new
    rest = iter(new.lstrip("+"))
    out = "".join(next(rest, "") if c.isalnum() else c for c in place)
    return out + "".join(rest)


def entities(text: str) -> set[tuple[str, str, str | None]]:
    """(kind, normal form, gender) of what is to be replaced in a text: a full name is its given name, with the gender that its title tells, and its surname."""
    out: set[tuple[str, str, str | None]] = set()
    found = spans(text)
    genders = titled_genders(text) if any(s[2] == "name" for s in found) else set()
    for _, _, kind, value in found:
        if kind.startswith("name"):
            given, _, last = value.partition(" ")
            out |= {("surname", last, None), *({("given", given, g) for name, g in genders if name == given} or {("given", given, None)})}
        else:
            out.add((kind, value, None))
    return out


def _found(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *e) for i, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t for e in sorted(entities(t), key=str)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "key", "kind", "value", "gender"])

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, kind string, value string, gender string")


def mapping(found: DataFrame, key: bytes, draw=surrogate, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, new): a surrogate for each distinct entity of found(kind, value, gender), all different, and none an original."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, gender, value, attempt = (c.to_pylist() for c in batch.columns)
            new = [draw(f"{k}:{g}" if g else k, v, a, key) for k, g, v, a in zip(kind, gender, value, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "gender", "value", "attempt", "new"])

    schema = "kind string, gender string, value string, attempt int, new string"
    vote = F.sum(F.when(F.col("gender") == "m", 1).when(F.col("gender") == "f", -1).otherwise(0))
    originals = found.groupBy("kind", "value").agg(vote.alias("vote")) if "gender" in found.columns else found.select("kind", "value", F.lit(0).alias("vote")).distinct()
    gender = F.when(F.col("vote") > 0, "m").when(F.col("vote") < 0, "f")
    now = written(originals.select("kind", gender.alias("gender"), "value", F.lit(0).alias("attempt")).mapInArrow(run, schema), "surrogates")
    for _ in range(rounds):
        first = now.groupBy("new").agg(F.min(F.struct("attempt", "kind", "value")).alias("first"), F.count("*").alias("many"))
        taken = now.select(F.col("value").alias("new")).distinct().withColumn("taken", F.lit(True))
        judged = now.join(first, "new").join(taken, "new", "left")
        again = F.coalesce("taken", F.lit(False)) | ((F.col("many") > 1) & (F.struct("attempt", "kind", "value") != F.col("first")))  # who has it keeps it
        judged = written(judged.select("kind", "gender", "value", "attempt", "new", again.alias("again")), "surrogates")
        discard(now)
        if not judged.where("again").limit(1).count():
            return judged.select("kind", "value", "new")
        anew = judged.where("again").select("kind", "gender", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(run, schema)
        now = written(judged.where("not again").select("kind", "gender", "value", "attempt", "new").unionAll(anew), "surrogates")
        short = judged.where("again")
    kinds = sorted(r.kind for r in short.select("kind").distinct().collect())  # a few kinds
    raise ValueError(f"after {rounds} attempts there are not enough surrogates of {', '.join(kinds)}")


def _shown(kind: str, value: str, new: dict[tuple[str, str], str]) -> tuple[str, str]:
    """The kind and the surrogate's normal form that stand in a span's place."""
    whole, _, part = kind.partition("/")
    if whole != "name":
        return kind, new[kind, value]
    given, _, last = value.partition(" ")
    words = ([] if part == "last" else [new["given", given]]) + ([] if part == "given" else [new["surname", last]])
    return "name", " ".join(words)


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """docs(doc_id, text, ...) with surrogates in the texts, and n_replaced: how many places they took."""
    found = written(_found(docs), "entities")
    often = found.groupBy("kind", "value").agg(F.count("*").alias("many"))
    new = written(mapping(found, key), "surrogates").join(often, ["kind", "value"])
    known = join_frequent(found, new, ["kind", "value"], found.count())
    of_doc = known.groupBy(F.col("doc_id").alias("_of_doc"), F.col("key").alias("_of_text")).agg(F.collect_set(F.struct("kind", "value", "new")).alias("_entities"))
    names = [c for c in docs.columns if c != "n_replaced"]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, entries in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                n = 0
                if entries:
                    new = {(e["kind"], e["value"]): e["new"] for e in entries}
                    out, end = [], 0
                    for start, stop, kind, value in spans(text):
                        out += [text[end:start], spelt(*_shown(kind, value, new), text[start:stop])]
                        end, n = stop, n + 1
                    text = "".join([*out, text[end:]])
                texts.append(text)
                counts.append(n)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*names, "n_replaced"])

    met = docs.join(of_doc, docs.doc_id.eqNullSafe(of_doc._of_doc) & (F.xxhash64(docs.text) == of_doc._of_text), "left")
    kept = met.select(*(docs[c] for c in names), "_entities")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return kept.mapInArrow(run, f"{fields}, n_replaced long")
