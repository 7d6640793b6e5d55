"""Surrogates: formats kept, one to one over a corpus and within full formats, equal mentions equal, nothing raised."""

import itertools
import random
import re
import string

import pytest

from tidemark.llm import queries
from tidemark.llm import surrogates as S

SCHEMA = "doc_id long, text string, n_entities string"


def replaced(text, key=S.TEST_KEY):
    return S.rewrite(text, {}, key)[0]


@pytest.mark.parametrize("n", [2, 3, 7, 10, 26, 100, 1000, 4097])
def test_permutation(n):
    there = [S.permute(x, n, b"k", "f") for x in range(n)]
    assert sorted(there) == list(range(n)) and [S.permute(y, n, b"k", "f", back=True) for y in there] == list(range(n))


def test_full_formats_are_one_to_one():
    quads = [".".join(map(str, x)) for x in itertools.product(range(10), repeat=4)]
    out = [S.surrogate("ip", q) for q in quads]
    assert len(set(out)) == len(quads) and not any(a == b for a, b in zip(quads, out, strict=True))
    mails = [S.surrogate("email", f"{c}@x.com") for c in string.ascii_lowercase]
    assert len(set(mails)) == 26
    cards = [S.surrogate("card", f"4111111111111{i:03d}") for i in range(1000)]
    assert len(set(cards)) == 1000 and all(S.luhn(a) == S.luhn(f"4111111111111{i:03d}") for i, a in enumerate(cards))


@pytest.mark.parametrize(
    ("text", "same"),
    [
        ("電話 ０３-１２３４-５６７８", r"電話 [０-９]{2}-[０-９]{4}-[０-９]{4}"),
        ("card ٤١١١ ١١١١ ١١١١ ١١١١ end", r"card ٤[٠-٩]{3} [٠-٩]{4} [٠-٩]{4} [٠-٩]{4} end"),
        ("İstanbul@example.com", r"\w{8}@[a-z]{7}\.com"),
        ("Иванов@пример.рф", r"[А-Я][а-я]{5}@[а-я]{6}\.рф"),
        ("a" * 70 + "@x.com", r"[a-z]{70}@[a-z]\.com"),
        ("Call +49 30 1234567, 01 23 45 67 89", r"Call \+4\d \d\d \d{7}, \d\d \d\d \d\d \d\d \d\d"),
        ("3782 822463 10005", r"3\d{3} \d{6} \d{5}"),
        ("DE89 3704 0044 0532 0130 00", r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d"),
        ("at 2001:db8::8a2e:370:7334", r"at 2001:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4}"),
        ("key: 9233A8ECF7C5B09FE5949719B6B82BC439E9329B", r"key: [0-9A-F]{40}"),
        ("password = hunter2abc", r"password = [a-z0-9]{10}"),
        ("Мария Иванова", r"[А-Я][а-я]{3}я [А-Я][а-я]{5}а"),
        ("Mrs ANNA Neil", r"Mrs [A-Z]{3}A [A-Z][a-z]{2}l"),
        ("x" * 30_000 + "@y.com", r"[a-z]{30000}@[a-z]\.com"),
    ],
)
def test_formats(text, same):
    out = replaced(text)
    assert re.fullmatch(same, out) and out != text and len(out) == len(text)
    assert out != replaced(text, b"another key") and out == replaced(text)


@pytest.mark.parametrize("text", ["", "Dr 中文字符", "Prof αβγδε", "12:30:45 on 01.02.2023, 12 34", "a@b", "@", "Marie", "999.1.2.3", "key: word"])
def test_left_alone(text):
    assert S.rewrite(text, {}) == (text, [])


def test_persons():
    out = replaced("Frau Dr. Anna Maria Schmidt-Ott met John Q. Smith. Schmidt-Ott left; Smith stayed. The smith works.")
    m = re.fullmatch(r"Frau Dr\. (\w+a) (\w+a) (\w+-\w+) met (\w+n) (\w)\. (\w+h)\. (\w+-\w+) left; (\w+) stayed\. The smith works\.", out)
    assert m and m[3] == m[7] and m[6] == m[8] and m[1] != "Anna" and m[2] != "Maria" and m[6] != "Smith"


@pytest.mark.parametrize("bound", [10_000, 0])
def test_corpus(spark, bound):
    """Over a corpus with dense formats: one surrogate an entity, one entity a surrogate, none that occurs where the format has room."""
    rng = random.Random(4)
    mails = [f"{rng.choice(['jo', 'al', 'mo'])}.{rng.choice('abcdefgh')}@{rng.choice(['x', 'y', 'zz'])}.com" for _ in range(60)]
    ips = [f"{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(0, 3)}.{rng.randint(0, 9)}" for _ in range(500)]
    phones = [f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}" for _ in range(200)]
    names = [f"Frau {a}{b}" for a in ("Ba", "Be", "Bi", "Bo", "Bu", "Da", "De") for b in ("l", "n", "rt")]
    every = [*mails, *ips, *phones, *names]
    rows = [(i, " ; ".join(rng.choice(every) for _ in range(rng.randint(0, 30))), "x") for i in range(300)] + [(300, None, "x"), (301, "", "x"), (302, mails[0].upper(), "x")]
    rows += rows[:2]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = sorted(((r.doc_id, r.text, r.n_entities) for r in S.replace(docs, b"key", bound).collect()), key=lambda r: (r[0], r[1] or ""))
    want = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    back, there = {}, {}
    for (i, text, _), (j, new, n) in zip(want, out, strict=True):
        assert i == j and (new is None) == (text is None)
        if not text:
            assert n == 0
            continue
        old, made = text.split(" ; "), new.split(" ; ")
        assert len(old) == len(made) == n
        for a, b in zip(old, made, strict=True):
            assert there.setdefault(a.lower(), b.lower()) == b.lower() and back.setdefault(b.lower(), a.lower()) == a.lower()
    occurring = set(there)
    assert len(there) > 400 and not any(a == b for a, b in there.items())
    assert not {b for a, b in there.items() if "555-" in a or "@" in a} & occurring
    dense = [b for a, b in there.items() if re.fullmatch(r"[\d.]+", a)]
    assert sum(b in occurring for b in dense) == 0


def test_brackets_far_ahead(spark):
    """A run of occurring values longer than the first look ahead still closes on free ones; a format that is full keeps its next values."""
    run = ["10.0.0.77", *(S.surrogate("ip", "10.0.0.77", j) for j in range(1, 60))]
    full = [f"{c}@x.com" for c in string.ascii_lowercase]
    octets = [".".join(map(str, (1, 2, 3, i))) for i in range(10)]
    assert len({*run}) == 60
    docs = spark.createDataFrame([(1, " ; ".join(run), None), (2, " ; ".join(full + octets), None)], SCHEMA)
    steps = {r.canon: r.step for r in S.resolve(S.entities(docs)).collect() if r.kind == "ip"}
    new = [S.surrogate("ip", x, steps.get(x, 1)) for x in run]
    assert len({*new}) == 60 and not {*new} & {*run} and max(steps.values()) == 119
    out = {r.doc_id: r.text.split(" ; ") for r in S.replace(docs).collect()}
    assert len({*out[1], *out[2]}) == 96 and out[1] == new


@pytest.mark.parametrize(
    ("text", "kinds", "same"),
    [
        ("Mr O'Brien came", ["surname"], r"Mr [A-Z]'[A-Z]\w{4} came"),
        ("Anna van der Berg left; Berg cried", ["given", "surname", "surname"], r"(\w{4}) van der (\w{4}) left; \2 cried"),
        ("Mohammed Al-Fayed", ["given", "surname"], r"\w{8} [A-Z]\w-[A-Z]\w{4}"),
        ("call me at 5551234567.", ["phone"], r"call me at \d{10}\."),
        ("Order 5551234567", [], "Order 5551234567"),
        ("Phone rings", [], "Phone rings"),
    ],
)
def test_wider_detection(text, kinds, same):
    out, found = S.rewrite(text, {})
    assert found == kinds and re.fullmatch(same, out) and (out != text or not kinds)


def test_hidden_collisions_move_on(spark):
    """An entity whose next value occurs takes the one its bracket closes at."""
    first = "10.0.0.77"
    chain = [S.surrogate("ip", first, j) for j in range(1, 3)]
    docs = spark.createDataFrame([(1, " ".join([first, *chain]), None)], SCHEMA)
    steps = {(r.canon): r.step for r in S.resolve(S.entities(docs)).collect()}
    assert steps == {first: 5, chain[0]: 3}
    out = S.replace(docs).first()
    assert out.n_entities == 3 and len(set(out.text.split())) == 3 and not set(out.text.split()) & {first, *chain}


def test_empty_table(spark):
    assert S.replace(spark.createDataFrame([], SCHEMA)).count() == 0


def one_to_one(kind, values):
    out = [S.surrogate(kind, v) for v in values]
    assert len(set(out)) == len(values), kind
    return out


@pytest.mark.parametrize("kind", ["surname", "given:f", "email"])
def test_scripts_share_no_surrogates(kind):
    """All values of two and three letters of small alphabets, plain and accented, of several scripts together."""
    letters = ["абёўіяжз", "αάβώωςηή", "aeéüñßbd", "abcxyz"]
    values = {"".join(x) for a in letters for k in (1, 2, 3) for x in itertools.product(a, repeat=k)} | {"".join(x) for x in itertools.product("aбα1ёά", repeat=3)}
    values = sorted({S.canonical("surname", v) for v in values})
    one_to_one(kind, [f"{v}@x.com" for v in values] if kind == "email" else values)


def test_letter_classes_partition():
    for name in (False, True):
        for c in map(chr, range(0x250)) if name else map(chr, range(0x530)):
            if c.isalpha():
                same = S.alphabet(c, name, "")
                assert c in same and all(S.alphabet(x, name, "") == same for x in same)


def test_secrets_share_no_surrogates():
    values = ["".join(x) for x in itertools.product("a1gf", repeat=4)] + ["".join(x) for x in itertools.product("A1Gf", repeat=4)] + ["".join(x) for x in itertools.product("abcdef", "0123456789", "abgz")]
    values = sorted(set(values))
    out = one_to_one("secret", values)
    assert all(bool(S.hexadecimal(a)) == bool(S.hexadecimal(b)) for a, b in zip(values, out, strict=True))
    every = ["".join(x) for x in itertools.product(string.ascii_lowercase, string.digits)]
    assert sorted(S.surrogate("secret", v) for v in every) == every


def test_padded_addresses():
    octets = ["0", "7", "00", "07", "42", "000", "042", "007", "100", "142", "255"]
    values = [".".join(x) for x in itertools.product(octets, repeat=2)]
    values = [f"{v}.{w}" for v in values for w in ("1.1", "001.1", "10.010")]
    out = one_to_one("ip", values)
    assert all(len(a) == len(b) and all(int(o) <= 255 and (len(o) > 1 and o[0] == "0") == (len(p) > 1 and p[0] == "0") for o, p in zip(b.split("."), a.split("."), strict=True)) for a, b in zip(values, out, strict=True))


def test_surnames_on_spark(spark):
    """2,304 people of three Cyrillic letters give 2,304 texts."""
    first, second, third = "БВГДЖЗКЛ", "аёеиіоуўыэюя", "бвгджзйклмнпрстфхцчшщщђћ"
    names = sorted({"".join(x) for x in itertools.product(first, second, third)})
    df = spark.createDataFrame([(i, f"Mr {n} came") for i, n in enumerate(names)], "doc_id long, text string").repartition(4)
    got = {r.text for r in S.replace(df).collect()}
    assert len(got) == len(names) > 2000


def test_key_outside_local_mode(spark, monkeypatch):
    class Far:
        conf, sparkContext = spark.conf, type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="surrogates.key"):
        S.session_key(Far)


def test_query_on_a_cluster_without_a_key(spark, monkeypatch, tmp_path):
    """The registered query runs on any master: one key is drawn for all its runs, not that of tests; a key that is set counts."""
    rows = [(1, "mail jo.doe@x.com, call +1 (212) 555-0187", "en", "s", 1), (2, "jo.doe@x.com", "en", "s", 1), (3, None, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(f"{tmp_path}/shared")
    run = lambda: {r.doc_id: r.text for r in queries.op4_pii_surrogates(spark, str(tmp_path)).collect()}
    tests = run()
    monkeypatch.setattr(spark.sparkContext, "master", "spark://driver:7077")
    drawn = run()
    assert drawn == run() and drawn[3] is None and drawn[2] in drawn[1] and len({drawn[2], tests[2], "jo.doe@x.com"}) == 3
    spark.conf.set(S.KEY_CONF, "a key")
    try:
        assert run()[1] == replaced(rows[0][1], b"a key")
    finally:
        spark.conf.unset(S.KEY_CONF)
