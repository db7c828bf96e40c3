"""Line rules, fill-in-middle and source divergence: against SQL, against brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from reviewlake.llm import divergence, fim, rules
from reviewlake.llm.queries import ORACLE_SQL, QUERIES

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c a b c"), (6, "a b c\n\na b c\n a b c"), (6, "a b c\n\na b c\n a b c"), (7, "word " * 30_000), (8, "x" * 60_000), (9, "1é" * 20_000), (10, "é à 日本 🎉▁  ▁"), (None, "null id"),
    (11, "holds <S> a marker"), (12, "Eins. Zwei! Drei?\r\nHome | About | Contact | Help\nAll rights reserved.\n" + "Ein Satz mit genug Wörtern, der endet.\n" * 9), (13, "\x00\x0b\x0c a b"), (14, "ab " * 5000 + "12 " * 5000),
]


def odd(spark, *clashing):
    return spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, keep string").select("*", *[F.lit("7").alias(c) for c in clashing])


@pytest.mark.parametrize("name", ["op11_line_rules", "op12_fill_in_middle", "op13_source_divergence"])
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, sf, QUERIES[name], ORACLE_SQL[name])


# -- line rules


def expected_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_measures(spark):
    rng = random.Random(3)
    more = [(100 + i, "".join(rng.choice(["a", "b", "a b c", " ", "\n", "# ", "é", "\t", "x. "]) for _ in range(rng.randint(0, 300)))) for i in range(60)]
    df = odd(spark, "kept", "N_WORDS", "_m").unionByName(spark.createDataFrame([(i, t, "x", "7", "7", "7") for i, t in more], "doc_id long, text string, keep string, kept string, N_WORDS string, _m string"))
    got = rules.measures(df).collect()
    assert len(got) == len(ODD) + len(more)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected_measures(r.text), r.text and r.text[:80]
        assert r.keep == "x" and (not r.kept or not r.base_failed) and 0 <= r.n_left <= r.n_words
    assert rules.measures(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("line", "fault"),
    [
        ("A sentence that ends.", None), ("Short heading", "punctuation"), ("a heading of as many as six words", None), ("Buy!! now!! here!! cheap!!", "punctuation"), ("word$$$ other### more&&&.", "punctuation"),
        ("Home | News | Sport | Weather and more of it.", "navigation"), ("You are in Home › Docs › Guides › First steps.", "navigation"), ("Released under the MIT License.", "boilerplate"), ("Todos los derechos reservados.", "boilerplate"), ("", None), (" \t", None), ("He said: “no”", None),
    ],
)
def test_line_faults(spark, line, fault):
    df = spark.createDataFrame([(line,)], "x string").select(rules.lines_of(F.col("x"))[0].alias("x"))
    assert df.select(rules.line_fault(F.col("x"), rules.line_words(F.col("x")))).first()[0] == fault


def test_documents_that_lose_too_much_go(spark):
    prose = "\n".join(" ".join(f"word{i}x{k}" for k in range(12)) + "." for i in range(20))
    menu = "\n".join(f"Home{i} | News{i} | Sport{i} | More{i} | Contact{i} | Help{i}" for i in range(60))
    df = spark.createDataFrame([(1, prose), (2, prose + "\n\nHome | News | More\nAll rights reserved."), (3, prose + "\n" + menu), (4, menu)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in rules.cleaned(df).collect()} == {1: prose, 2: prose + "\n"}
    assert [r.doc_id for r in rules.cleaned(df, lost=80).orderBy("doc_id").collect()] == [1, 2, 3]


def test_rules_run_no_python(spark, sf):
    plan = QUERIES["op11_line_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# -- fill in middle


def plain_fim(key, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    x = hashlib.sha256(key.encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted(v % (n + 1) for v in h[:2])
    p, m, s = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(5)
    shared = "".join(rng.choice("abc dé1\n") for _ in range(30_000))
    more = [(1000 + i, rng.choice(["", shared[:9000], shared[200:20_000]]) + "".join(rng.choice("abC 1é日<>") for _ in range(rng.randint(0, 400))) + rng.choice(["", shared])) for i in range(120)]
    df = spark.createDataFrame([(i, t, "x", "7") for i, t in ODD + more], "doc_id long, text string, keep string, form string")
    got = fim.transform(df).withColumn("back", fim.restored()).collect()
    assert len(got) == len(ODD) + len(more)
    for r in got:
        key = f"1:{'' if r.doc_id is None else r.doc_id}"
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(key, r.text), key
        assert r.back == (r.text or "") and r.keep == "x"
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0


def test_chunks_follow_content(spark):
    rng = np.random.default_rng(1)
    body = bytes(rng.choice(np.frombuffer(b"abcdefgh \n", np.uint8), 40_000))
    memo = fim.Memo()
    fim.Counted(b"one " + body, memo)
    before = len(memo.held)
    fim.Counted(b"another, longer start " + body + b" end", memo)
    assert memo.hits > 0.8 * before and len(memo.held) - before <= 5
    for text in (body, "é".encode() * 30_000, b"a" * 30_000, "日".encode() * 30_000, b"a\xc3\xa9" * 10_000):
        ends = fim.chunk_ends(np.frombuffer(text, np.uint8))
        parts = [text[a:z] for a, z in zip([0, *ends], ends, strict=False)]
        assert b"".join(parts) == text and max(map(len, parts)) <= fim.MOST + 3
        assert all(p.decode() for p in parts)


def test_memo_compares_bytes_and_stays_small():
    memo = fim.Memo(room=2000)
    first = memo.of(b"abc 1")
    memo.held = {k: (b"other", first) for k in memo.held}  # as if two chunks had one hash
    assert memo.of(b"abc 1") == first and memo.hits == 0
    for i in range(1000):
        memo.of(f"chunk {i}".encode())
    assert memo.used <= 2000 and len(memo.held) < 12


def test_cuts_at_every_token():
    text = ("ab1c" * 300 + "x" * 700 + " é," * 200 + "日本a" * 100).encode()
    counted = fim.Counted(text, fim.Memo())
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text.decode())
    assert counted.n == len(tokens)
    at = points = 0
    for k, t in enumerate(tokens):
        assert counted.cut(k) == (at, points)
        at, points = at + len(t.encode()), points + len(t)


# -- source divergence


def plain_audit(rows, least, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        groups[lang].add(source)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        v = len(kept)
        c = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        c[None] = {t: sum(c[s][t] for s in sources) for t in kept}
        price = {s: {t: 1 + 10**9 * (k + 2) // (sum(x.values()) + 2 * v) for t, k in x.items()} for s, x in c.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(o, sum(f(price[s][t], price[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, f(price[s][t], price[None][t])) for t in kept if c[s][t] > 0 and price[s][t] > price[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("columns", [1024, 7])
def test_divergence(spark, columns, monkeypatch):
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    monkeypatch.setattr(divergence, "ROWS", 20)
    rng = random.Random(columns)
    names = [None, "", "a", "b", "é", "日", "z" * 20]
    rows = []
    for _ in range(400):
        k = rng.choice([0, 1, 5, 40])
        rows.append((rng.choice([None, ""]) if k == 0 else " ".join(rng.choice(["The", "the", "é", "É", f"w{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 3))}", "x-y_z", "1a2"]) for _ in range(k)), rng.choice(["en", "en", "de", None]), rng.choice(names)))
    rows += [("hot " * 5000, "en", "a")] * 12 + [("", "xx", "one"), (None, "yy", "one"), ("few words", "yy", "two"), ("few words", "yy", "two")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, term long").repartition(6)
    got = [tuple(r) for r in divergence.audit(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 10, 10)
    assert divergence.audit(df.limit(0)).count() == 0
    assert {r.value for r in divergence.audit(df.filter("lang = 'yy'")).collect()} == {0}


def test_prices_above_64_bits(spark):
    big = 10**14
    got = spark.range(1).select(divergence.priced(F.lit(big), F.lit(3 * big), F.lit(5))).first()[0]
    assert got == 1 + 10**9 * (big + 2) // (3 * big + 10)


def test_joint_tables_of_tiles(monkeypatch):
    monkeypatch.setattr(divergence, "COLUMNS", 4)
    rng = np.random.default_rng(2)
    x = rng.random((30, 11)) < 0.3
    row, column = np.nonzero(x)
    found = {(int(i), int(j)): int(c) for a, b, n in divergence.joint(row, column, 30, 11) for i, j, c in zip(a, b, n, strict=True)}
    want = x.T.astype(int) @ x.astype(int)
    assert found == {(i, j): int(want[i, j]) for i in range(11) for j in range(i + 1, 11) if want[i, j]}
