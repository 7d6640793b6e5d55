"""Surrogates for personal data.

Detected entities (e-mail, telephone, card, social-security and bank account numbers, IP addresses, secrets, person names) are
replaced by keyed surrogates of the same type: digits stay digits of their own script, letters stay letters of their script and
case, separators, length and grouping stay, Luhn and IBAN checks hold where they held, names keep vowels, consonants and the last
letter, which carries their gender.

A format (type, and class of the character at each place) is a finite set of values. A keyed permutation E (a Feistel network
with cycle walking) puts them on one cycle; an entity's surrogate is the next value on it, so within a format

* equal entities get equal surrogates in all documents (coreference; case and grouping do not count), and
* different entities get different ones, and none itself, by construction (distinctness), however full the format is.

The collision check then keeps surrogates off values that occur in the corpus: where the next value occurs, the entity takes
the value further on that pairs with it as brackets pair (an occurring value opens, a free one closes), which stays one to one.
The search looks ``STEPS`` values ahead and four times as far for those still open, to the end of the cycle if need be. Where none closes on
the whole cycle, more than half of the format's values occur and there are not free values for all: the next value is kept, which is
another occurring entity's, yet still nobody else's surrogate. Nothing is drawn again and nothing is raised. Entities that went
further than one step reach the texts in a broadcast table of up to ``BROADCAST`` rows, else by a join on the documents that mention them.

The key is an argument, else the session's ``spark.tidemark.surrogates.key``; a local master may do without, with a constant fit for tests only.
The registered query, which must run with no settings of its own, takes ``application_key``: on a cluster without a key one is drawn.
Formats never overlap: the classes of characters that stand for each other partition each block of letters, a format's name holds all of them, padded octets of addresses
stay padded, and hexadecimal secrets are a format apart from other secrets, which are walked past hexadecimal values.

What is not found: names without a title or a known given name, names in scripts without capitals, runs of under 13 digits without grouping or a word for telephone before them.

Defined results: null text stays null and empty text empty, with 0 entities; repeated rows get equal texts; an empty table gives an
empty table; extra columns are kept (n_entities and entity_kinds of ``replace`` supersede columns of those names).
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import secrets
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import id_and_text, materialise

#: For tests. Anyone who knows the key can undo the replacement.
TEST_KEY = b"tidemark-surrogates"
KEY_CONF = "spark.tidemark.surrogates.key"
BROADCAST = 10_000
STEPS = 16
#: Places of a value that the permutation covers; those after them are shifted by a stream that depends on the covered ones.
COVERED = 32
FEISTEL_ROUNDS = 8

# Given names that are known by (script, gender), and titles by gender. They only serve detection.
GIVEN = {
    ("latin", "f"): (
        "Anna Maria Laura Julia Sophie Emma Clara Elena Marie Camille Lucia Carmen Ingrid Nadia Olivia Alice Mary Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa "
        "Margaret Sandra Emily Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Angela Helen Katharina Petra Monika Claudia Isabelle Nathalie Pilar Dolores Priya "
        "Fatima Aisha Leila Zainab Yuki Sakura Hana Mei Ananya Deepika Amina Ngozi Ebru Agnieszka Zofia Astrid Giulia Chiara Ines Beatriz"
    ),
    ("latin", "m"): (
        "Thomas Peter Michael Daniel Martin Paul Marco David Lukas Pierre Antoine Carlos Miguel Stefan Oliver James John Robert William Richard Joseph Charles Christopher Matthew Anthony "
        "Donald Steven Andrew Joshua Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Nicholas Eric Stephen Hans Klaus Wolfgang Jean Philippe Javier Alejandro Rahul "
        "Mohammed Muhammad Mohamed Ahmed Ali Omar Hassan Ibrahim Hiroshi Kenji Takeshi Haruto Arjun Vikram Kwame Mehmet Piotr Krzysztof Lars Giovanni Luca Diego Joao Rafael"
    ),
    ("latin", "-"): "Wei Ming Jing Xin",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана",
    ("cyrillic", "m"): "Иван Пётр Михаил Алексей Сергей Дмитрий Николай Андрей",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία",
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας",
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra", "m": "Mr Herr Monsieur Señor Sr", "-": "Dr Prof"}
TITLES = {t: g for g, v in TITLES.items() for t in v.split()}
GENDER = {n: g for (_, g), v in GIVEN.items() for n in v.split()}
HEX = "0123456789abcdef"
VOWELS = frozenset("aeiouyаеёиоуыэюяαεηιουω")
SECRET_NAMES = ("token", "secret", "password", "passwd", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "key")
CLOUD_PREFIXES = ("AKIA", "ASIA")

_NUMBER = re.compile(
    r"(?=[\d+(])(?<![\w.+-])(?:(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\d])(?!\.\d)"
    r"|(?P<card>\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{1,7}|\d{4}([ -])\d{6}\4\d{5})(?!\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?!\d)"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?|\+\d{8,15}"
    r"|\+\d{1,3}(?:[ .-]\(?\d{1,8}\)?){2,6}|0\d{1,4}(?: \d{2,8}){1,5})(?!\d))"
)
_HOST = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_ASSIGNED = re.compile(r"[=:][ \t]*[\"']?([A-Za-z0-9_/+-]{8,})")
_CLOUD = re.compile(rf"\b(?:{'|'.join(CLOUD_PREFIXES)})[A-Z0-9]{{16}}\b")
# a line break may stand before the number, after other separators
_BARE = re.compile(r"\d{7,12}(?![\w-])")
_CUE = re.compile(r"\b(?:phone|telephone|tel|mobile|cell|fax|call|dial)\b(?:[ .:#]{1,6}(?:me|us|is|at|on|no|number)\b){0,2}[ .:#]{1,6}$", re.IGNORECASE)
#: More code points than what ``_CUE`` may cover.
_CUE_WINDOW = 48
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.])")


def _capitals() -> str:
    """All upper-case letters, as ranges of a character class."""
    at = [c for c in range(65, sys.maxunicode) if chr(c).isupper()]
    out, start = [], at[0]
    for a, b in zip(at, [*at[1:], -1], strict=True):
        if b != a + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}")
            start = b
    return "".join(out)


_CAPITAL = rf"[{_capitals()}]"
_WORD = rf"{_CAPITAL}(?:['’]{_CAPITAL})?[^\W\d_]+"
# Words without a capital between given name and surname.
_PARTICLES = "van von der den de del della da das dos di du la le el al bin ibn ben ter ten zu zum zur".replace(" ", "|")
_NAME = rf"{_WORD}(?:-{_WORD})*"
_KNOWN = "|".join(sorted(GENDER, key=len, reverse=True))
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_PERSON = re.compile(
    rf"\b(?={_CAPITAL})(?:(?P<title>{_TITLE})\.? (?:(?:{_TITLE})\.? )*(?:(?P<first>{_NAME}) )?|(?P<given>{_KNOWN}) )"
    rf"(?P<middle>(?:(?:{_KNOWN}|[A-Z]\.) )*)(?:(?:{_PARTICLES}) ){{0,3}}(?P<last>(?!(?:{_TITLE})\b){_NAME})\b"
)
_CAPITALISED = re.compile(rf"\b{_NAME}\b")
Found = tuple[int, int, str]


def _emails(text: str) -> Iterator[Found]:
    at = text.find("@")
    while at >= 0:
        start, host = at, _HOST.match(text, at + 1)
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        if host and start < at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            yield start, host.end(), "email"
        at = text.find("@", at + 1)


def _secrets(text: str) -> Iterator[Found]:
    for m in _ASSIGNED.finditer(text):
        before, value = m.start(), m[1]
        while before and text[before - 1] in " \t\"'":
            before -= 1
        if not text[max(0, before - 10) : before].lower().endswith(SECRET_NAMES):
            continue
        if len(value) >= 16 or (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            yield m.start(1), m.end(1), "secret"
    if any(p in text for p in CLOUD_PREFIXES):
        yield from ((m.start(), m.end(), "secret") for m in _CLOUD.finditer(text))


def _numbers(text: str) -> Iterator[Found]:
    for m in _NUMBER.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if m.lastgroup == "ip" and any(int(x) > 255 for x in m["ip"].split(".")):
            continue
        if m.lastgroup == "phone" and not 7 <= digits <= 15 or (m["phone"] or "").startswith("0") and " " in m[0] and digits < 9:
            continue
        yield m.start(), m.end(), m.lastgroup
    yield from ((m.start(), m.end(), "phone") for m in _BARE.finditer(text) if _CUE.search(text, max(0, m.start() - _CUE_WINDOW), m.start()))
    for m in _IBAN.finditer(text):
        if iban_rest(canonical("iban", m[0])) == 1:
            yield m.start(), m.end(), "iban"
    if "::" in text or text.count(":") >= 7:
        for m in _IPV6.finditer(text):
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            if any(c not in ":" for c in m[0]):
                yield m.start(), m.end(), "ipv6"


def _persons(text: str) -> Iterator[Found]:
    surnames = set()
    for m in _PERSON.finditer(text):
        gender = TITLES[m["title"]] if m["title"] else GENDER[m["given"]]
        for g in ("first", "given"):
            if m[g]:
                yield m.start(g), m.end(g), f"given:{GENDER.get(m[g], gender)}"
        at = m.start("middle")
        for part in m["middle"].split():
            at = text.index(part, at)
            yield at, at + len(part), f"given:{GENDER.get(part, '-')}"
        yield m.start("last"), m.end("last"), "surname"
        surnames.add(m["last"])
    if surnames:  # the surname alone, elsewhere in the document, is the same person
        yield from ((m.start(), m.end(), "surname") for m in _CAPITALISED.finditer(text) if m[0] in surnames and len(m[0]) > 3)


def detect(text: str) -> list[Found]:
    """(start, end, kind) of the entities, in order, without overlap."""
    found = [*_emails(text), *_numbers(text), *_secrets(text), *_persons(text)]
    out, end = [], 0
    for s, e, k in sorted(found, key=lambda f: (f[0], -f[1])):
        if s >= end:
            out.append((s, e, k))
            end = e
    return out


def _low(c: str) -> str:
    return c.lower() if len(c.lower()) == 1 else c


def _up(c: str) -> str:
    return c.upper() if len(c.upper()) == 1 else c


def canonical(kind: str, surface: str) -> str:
    """What mentions of one entity share: digits by their value, letters without case; never longer than the surface."""
    if kind in ("phone", "card", "ssn"):
        return "".join(str(unicodedata.decimal(c)) for c in surface if c.isdecimal())
    if kind == "ip":
        return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in surface)
    if kind == "iban":
        return surface.replace(" ", "")
    return surface if kind == "secret" else "".join(map(_low, surface))


def dress(kind: str, surface: str, canon: str) -> str:
    """The replacement in the surface's grouping, digits and case."""
    if kind == "secret":
        return canon
    held = iter(canon)
    if kind == "iban":
        return "".join(c if c == " " else next(held) for c in surface)
    if kind in ("phone", "card", "ssn", "ip"):
        # a script's ten digits follow each other
        return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(held))) if c.isdecimal() else c if kind != "ip" else next(held) for c in surface)
    return "".join(_up(c) if s.isupper() else c for c, s in zip(canon, surface, strict=True))


def luhn(digits: str) -> int:
    """0 for a valid number."""
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10


def iban_rest(canon: str) -> int:
    """1 for a valid number."""
    return int("".join(str(int(c, 36)) for c in canon[4:] + canon[:4])) % 97


#: Letters that a script's plain alphabet holds; others of the same block (accented, of other languages) are a class of their own.
PLAIN = (("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"), ("α", "ω"), ("Α", "Ω"))


def letter_class(c: str, name: bool) -> tuple:
    """What letters that may stand for each other have in common: block, category, plain or not, and in names vowel or not. Letters whose case can't be changed back and forth stay alone."""
    if len(c.upper()) != 1 or len(c.lower()) != 1 or c not in (c.upper().lower(), c.lower().upper()):
        return (c,)
    plain = any(low <= c <= high for low, high in PLAIN)
    vowel = name and unicodedata.normalize("NFD", _low(c))[0] in VOWELS
    return ord(c) >> 7, unicodedata.category(c), plain, vowel


@lru_cache(65_536)
def alphabet(c: str, name: bool, digits: str) -> str:
    """The characters that may stand for c, the same for each of them; c alone if it stays. digits: those of a hexadecimal value, which stand for each other."""
    if c in digits:
        return digits
    if "0" <= c <= "9":
        return "0123456789"
    if not c.isalpha():
        return c
    own, low = letter_class(c, name), ord(c) & ~127
    return "".join(x for x in map(chr, range(low, low + 128)) if x.isalpha() and x not in digits and letter_class(x, name) == own)


def hexadecimal(value: str) -> str:
    """The letters of a value of decimal digits and letters a-f of one case, both there; else nothing."""
    letters = set(value).difference(HEX[:10])
    return next((d for d in ("abcdef", "ABCDEF") if letters and len(letters) < len(set(value)) and letters <= set(d)), "")


def _digest(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), key=key[:64], digest_size=32).digest(), "big")


def permute(x: int, n: int, key: bytes, form: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. n - 1 or its inverse: Feistel rounds on a square that holds n values, walked until a value lies below n."""
    side = math.isqrt(max(n - 1, 0)) + 1
    while True:
        a, b = divmod(x, side)
        for r in range(FEISTEL_ROUNDS):
            if back:
                a, b = (b - _digest(key, form, FEISTEL_ROUNDS - 1 - r, a)) % side, a
            else:
                a, b = b, (a + _digest(key, form, r, b)) % side
        x = a * side + b
        if x < n:
            return x


def _next_value(canon: str, steps: int, key: bytes, kind: str, keep: int = 0, tail: int = 0, name: bool = False, walk: bool = False) -> str:
    """The value ``steps`` further on the cycle of canon's format; the first ``keep`` and last ``tail`` characters stay."""
    body = canon[keep : len(canon) - tail]
    letters = hexadecimal(body) if kind == "secret" and not walk else ""
    spaces = [letters if c in letters else alphabet(c, name, HEX if kind == "ipv6" else "") for c in body]
    places = [i for i, s in enumerate(spaces) if len(s) > 1]
    form = f"{_digest(key, kind, canon[:keep], canon[len(canon) - tail :], *spaces):x}"
    out, n, x = list(body), 1, 0
    for i in places[:COVERED]:
        x, n = x * len(spaces[i]) + spaces[i].index(body[i]), n * len(spaces[i])
    if n == 1:
        return canon
    y = permute((permute(x, n, key, form) + steps) % n, n, key, form, back=True)
    for i in reversed(places[:COVERED]):
        y, at = divmod(y, len(spaces[i]))
        out[i] = spaces[i][at]
    covered = "".join(body[i] for i in places[:COVERED])
    for j, i in enumerate(places[COVERED:]):
        shift = _digest(key, form, "rest", j // 16, covered) >> 16 * (j % 16) & 65535
        out[i] = spaces[i][(spaces[i].index(body[i]) + shift + steps) % len(spaces[i])]
    if kind == "secret" and not letters and hexadecimal("".join(out)):  # those are a format of their own: walk on until the value isn't one of it
        return _next_value("".join(out), steps, key, kind, walk=True)
    return canon[:keep] + "".join(out) + canon[len(canon) - tail :]


_OCTET = {1: (0, 9), 2: (10, 99), 3: (100, 255)}


@lru_cache(65_536)
def surrogate(kind: str, canon: str, steps: int = 1, key: bytes = TEST_KEY) -> str:
    """The canonical form of the replacement: for e-mail the local part's, with the host left to ``host``."""
    if kind == "ip":
        octets = canon.split(".")
        sizes = [_OCTET[len(o)] if o == str(int(o)) else (0, 10 ** (len(o) - 1) - 1) for o in octets]  # padded ones stay padded
        n, x = 1, 0
        for o, (low, high) in zip(octets, sizes, strict=True):
            x, n = x * (high - low + 1) + int(o) - low, n * (high - low + 1)
        form = "ip|" + "|".join(f"{low}-{high}-{len(o)}" for o, (low, high) in zip(octets, sizes, strict=True))
        y, out = permute((permute(x, n, key, form) + steps) % n, n, key, form, back=True), []
        for o, (low, high) in reversed(list(zip(octets, sizes, strict=True))):
            y, at = divmod(y, high - low + 1)
            out.append(str(low + at).zfill(len(o)))
        return ".".join(reversed(out))
    if kind == "email":
        local, host = canon.split("@", 1)
        return _next_value(local, steps, key, f"email|{host}") + "@" + host
    if kind == "host":
        return _next_value(canon, steps, key, kind, tail=len(canon) - canon.rfind("."))
    if kind == "card":  # the digit's distance from the right one stays, so validity does
        off = luhn(canon)
        out = _next_value(canon[:-1], steps, key, f"card|{off}", keep=1)
        return out + str((off - luhn(out + "0")) % 10)
    if kind == "iban":
        out = _next_value(canon[4:], steps, key, f"iban|{canon[:2]}")
        return canon[:2] + f"{98 - iban_rest(canon[:2] + '00' + out):02d}" + out
    if kind == "phone":
        return _next_value(canon, steps, key, kind, keep=int(len(canon) > 10))
    if kind == "ipv6":
        return _next_value(canon, steps, key, kind, keep=canon.index(":"))
    if kind == "surname" or kind.startswith("given"):
        return _next_value(canon, steps, key, kind, tail=int(len(canon) > 2), name=True)
    return _next_value(canon, steps, key, kind)


def rewrite(text: str, steps: dict[tuple[str, str], int], key: bytes = TEST_KEY) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of what was found; steps: entities that go further than one."""
    out, end, kinds = [], 0, []
    for s, e, kind in detect(text):
        canon = canonical(kind, text[s:e])
        new = surrogate(kind, canon, steps.get((kind, canon), 1), key)
        if kind == "email":
            local, host = new.split("@", 1)
            new = local + "@" + surrogate("host", host, steps.get(("host", host), 1), key)
        out += [text[end:s], dress(kind, text[s:e], new)]
        end = e
        kinds.append(kind.split(":")[0])
    return "".join([*out, text[end:]]), kinds


def _named(text: str) -> Iterator[tuple[str, str]]:
    """(kind, canonical form) of the entities; an e-mail's host is one of its own."""
    for s, e, kind in detect(text):
        canon = canonical(kind, text[s:e])
        yield kind, canon
        if kind == "email":
            yield "host", canon.split("@", 1)[1]


def entities(docs: DataFrame) -> DataFrame:
    """kind, canon, n: the distinct entities of all documents with how often they occur; on disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[tuple[str, str], int] = {}
            for t in b["text"]:
                for x in _named(t.as_py()):
                    n[x] = n.get(x, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in n], pa.string()), pa.array([x[1] for x in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["kind", "canon", "n"])

    found = id_and_text(docs).select("text").mapInArrow(run, "kind string, canon string, n long")
    return materialise(found.groupBy("kind", "canon").agg(F.sum("n").alias("n")), "entities")


def _values(rows: DataFrame, key: bytes, low: int, high: int) -> DataFrame:
    """kind, canon, step, value: the values low .. high further on, null where the cycle is back at the entity; e-mails have none, as their hosts are checked."""

    def ahead(kind: str, canon: str) -> Iterator[tuple]:
        for j in range(low, high + 1):
            value = surrogate(kind, canon, j, key)
            yield kind, canon, j, None if value == canon else value
            if value == canon:
                return

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["kind", "canon", "step", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, c in zip(b["kind"].to_pylist(), b["canon"].to_pylist(), strict=True):
                for x in ahead(k, c):
                    out.append(x)
                    if len(out) >= 50_000:
                        yield batch(out)
                        out = []
            yield batch(out)

    return rows.filter("kind != 'email'").select("kind", "canon").mapInArrow(run, "kind string, canon string, step long, value string")


def resolve(found: DataFrame, key: bytes = TEST_KEY) -> DataFrame:
    """kind, canon, step of the entities that go further than one step, as their next value occurs; on disk."""
    occurs = found.select("kind", F.col("canon").alias("value"))
    taken = materialise(_values(found, key, 1, 1).join(occurs, ["kind", "value"], "left_semi").select("kind", "canon"), "taken")
    along = Window.partitionBy("kind", "canon").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    # the entity and its next value have opened a bracket each
    closed, still, low, high = [], taken.withColumn("depth", F.lit(2).cast("long")), 2, STEPS
    while True:
        ahead = _values(still, key, low, high).join(occurs.withColumn("there", F.lit(1)), ["kind", "value"], "left")
        change = F.when(F.col("value").isNull(), 0).when(F.col("there").isNull(), -1).otherwise(1)
        # the running sum starts from what the steps before left open
        depths = ahead.withColumn("change", change).withColumn("run", F.sum("change").over(along)).join(still, ["kind", "canon"])
        seen = depths.groupBy("kind", "canon").agg(
            F.min(F.when(F.col("depth") + F.col("run") == 0, F.col("step"))).alias("step"), F.max(F.col("value").isNull()).alias("ended"),
            (F.max("depth") + F.sum("change")).alias("depth"),
        )
        seen = materialise(seen, "steps")
        closed.append(seen.filter("step is not null").select("kind", "canon", "step"))
        still, low, high = seen.filter("step is null and not ended").select("kind", "canon", "depth"), high + 1, high * 4
        if still.isEmpty():
            return reduce(DataFrame.unionByName, closed)


def session_key(spark: SparkSession) -> bytes:
    """The session's key; the key of tests only where the master is local."""
    key = spark.conf.get(KEY_CONF, None)
    if key is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {KEY_CONF}, or give a key: who knows the default can undo the replacement")
    return key.encode() if key is not None else TEST_KEY


@cache
def _drawn_key() -> bytes:
    """One key for all calls of this driver process; it is written nowhere."""
    return secrets.token_bytes(32)


def application_key(spark: SparkSession) -> bytes:
    """As ``session_key``, but outside local mode without a key one is drawn: nobody can undo the replacement, and another application's surrogates differ."""
    if spark.conf.get(KEY_CONF, None) is None and not spark.sparkContext.master.startswith("local"):
        return _drawn_key()
    return session_key(spark)


def replace(docs: DataFrame, key: bytes | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """The documents' columns with text rewritten, and n_entities, entity_kinds (array, in order of occurrence)."""
    key = session_key(docs.sparkSession) if key is None else key
    own = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    more = resolve(entities(docs), key)
    rows, few = docs.select(*own).withColumn("__tm_text", F.col("text")), more.limit(broadcast + 1).collect()
    known = {(r["kind"], r["canon"]): r["step"] for r in few} if len(few) <= broadcast else {}
    if len(few) > broadcast:
        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(d, h, *x) for d, h, t in zip(b["doc_id"].to_pylist(), b["th"].to_pylist(), b["text"], strict=True) for x in set(_named(t.as_py()))]
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "th", "kind", "canon"])

        each = id_and_text(docs).withColumn("th", F.xxhash64("text")).mapInArrow(mentions, "doc_id long, th long, kind string, canon string")
        by_doc = each.join(more, ["kind", "canon"]).groupBy(F.col("doc_id").alias("__tm_id"), F.col("th").alias("__tm_th")).agg(F.collect_set(F.struct("kind", "canon", "step")).alias("__tm_more"))
        th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
        rows = rows.join(by_doc, rows["doc_id"].cast("long").eqNullSafe(by_doc["__tm_id"]) & (th == by_doc["__tm_th"]), "left").drop("__tm_id", "__tm_th")
    else:
        rows = rows.withColumn("__tm_more", F.lit(None).cast("array<struct<kind:string,canon:string,step:bigint>>"))
    schema = rows.drop("__tm_more", "__tm_text").schema.add("n_entities", T.LongType()).add("entity_kinds", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kinds = [], []
            for t, extra in zip(b["__tm_text"], b["__tm_more"].to_pylist(), strict=True):
                new, k = rewrite(t.as_py(), {(x["kind"], x["canon"]): x["step"] for x in extra} if extra else known, key) if t.is_valid else (None, [])
                texts.append(new)
                kinds.append(k)
            own_cols = [pa.array(texts, pa.string()) if c == "text" else b[c] for c in own]
            yield pa.RecordBatch.from_arrays([*own_cols, pa.array([len(k) for k in kinds], pa.int64()), pa.array(kinds, pa.list_(pa.string()))], [*own, "n_entities", "entity_kinds"])

    return rows.mapInArrow(run, schema)
