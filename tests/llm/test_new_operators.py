"""Alignment, periodic runs and licence scan against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import alignment, byte_bpe, licenses, links, packing, passages, periodic, secrets
from shelfwise.llm.common import sized_batches, table_saved
from shelfwise.llm.queries import QUERIES

#: Names that operators use inside stand here as further columns of the input.
SCHEMA = "doc_id bigint, text string, row string, runs int, pairs int, id string, blocks int, n_words int, kept string, found int"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i * 7 % 401}" for i in range(9_000))
TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (4, "one"), (5, LONG), (6, "a b c " * 9), (7, "é 日本 🙂 \x00 naïve—don't\n\n  x\r\ny \xa0z \u3000 end "),
    (None, "no id at all"), (None, "another without id"), (8, "▁ is the mark of pieces"), (9, "<s> <|endoftext|> </s> <0x41> [UNK]"), (10, "x  y   z    "), (11, " lead"),
    (12, "1234567890 3.14159 $%^&*()_+ {}[]"), (13, "日本語のテキスト、空白なし。" * 30), (14, "\n \n a\t\tb \u2028 c\x1c d"), (15, "🙂" * 40), (16, "x x x y x x x y x x x y x x x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "r", 1, 2, "i", 3, 4, "k", 5) for i, t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def vocabularies():
    with open(A, "rb") as a, open(B, "rb") as b:
        return a.read(), b.read()


# 11: alignment


def aligned_plainly(texts, a_json, b_model, side=None):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, from tokens of whole texts and their bytes alone."""
    side = side or alignment.Aligner(a_json, b_model)
    every, documents = [], Counter()
    for t in texts:
        a, b = (side.a.encode(" " + t, add_special_tokens=False).ids, side.b.encode(t)) if t else ([], [])
        x, y = [side.a_bytes[i] for i in a], [side.b_bytes[i] for i in b]
        groups, links = [], Counter()
        if t and b"".join(x) == b"".join(y) == (" " + t).encode():
            i = j = 0
            while i < len(a):
                p, q, left, right = i + 1, j + 1, len(x[i]), len(y[j])
                while left != right:
                    if left < right:
                        left, p = left + len(x[p]), p + 1
                    else:
                        right, q = right + len(y[q]), q + 1
                groups.append((a[i:p], b[j:q]))
                links.update((u, v) for u in a[i:p] for v in b[j:q])
                i, j = p, q
        documents.update(links.keys())
        every.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), groups, links))
    best: dict[int, int] = {}
    for (u, _), n in documents.items():
        best[u] = max(best.get(u, 0), n)
    return [
        (
            n_a, n_b, len(groups), links.total(), sum(k for (u, v), k in links.items() if documents[u, v] == best[u]),
            sum(k * documents[p] for p, k in links.items()), ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups),
        )
        for n_a, n_b, groups, links in every
    ]


def test_alignment_against_whole_texts(spark, docs, no_docs, vocabularies):
    shared = alignment.vocabularies(spark, A, B)
    out = alignment.align(docs, shared)
    counts = alignment.pair_counts(out)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    want = Counter((i, t, *x) for (i, t), x in zip(TEXTS, aligned_plainly([t for _, t in TEXTS], *vocabularies)))
    for most in (alignment.BROADCAST_PAIRS, 40, 0):  # all pairs broadcast, some, none
        got = alignment.rated(out, counts, most).select("row.doc_id", "row.text", *names).collect()
        assert Counter(map(tuple, got)) == want
    for r in out.filter("n_groups > 0").select("row.text", "n_groups", "ends").collect():
        assert len(r.ends) == r.n_groups and r.ends == sorted(set(r.ends)) and r.ends[-1] == len((" " + r.text).encode())
    assert alignment.rated(alignment.align(no_docs, shared), alignment.pair_counts(alignment.align(no_docs, shared))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\xa0\u3000abcAB.,!'é日本🙂▁<0x>\x00\x1c1_"), max_size=30), min_size=1, max_size=8))
def test_alignment_of_any_text(vocabularies, texts):
    aligner = _one_aligner(vocabularies)
    for t, got in zip(texts, aligner.align(texts)):
        n_a, n_b, n_groups, _, _, _, groups = aligned_plainly([t], *vocabularies, side=aligner)[0]
        got = got or []
        assert ";".join(x[0] for x in got) == groups
        assert tuple(sum(x[k] for x in got) for k in (3, 4, 5)) == (n_a, n_b, n_groups)


_kept = {}


def _one_aligner(vocabularies):
    if not _kept:
        _kept[0] = alignment.Aligner(*vocabularies)
    assert _kept[0].cuts
    return _kept[0]


def test_alignment_of_tokenizers_that_cannot_be_cut(vocabularies):
    """Without cuts at spaces whole texts give the same groups."""
    aligner, whole = _one_aligner(vocabularies), alignment.Aligner(*vocabularies)
    whole.cuts = False
    texts = [t or "" for _, t in TEXTS]
    for x, y in zip(aligner.align(texts), whole.align(texts)):
        assert (x is None) == (y is None) and (x is None or ";".join(p[0] for p in x) == y[0][0])


def test_alignment_keeps_what_is_met_again(vocabularies, monkeypatch):
    """A piece that comes in every batch is tokenized once, however many others turn up between; results stay the same."""
    monkeypatch.setattr(alignment, "REMEMBERED", 160)  # some eight batches
    aligner, plain, seen = alignment.Aligner(*vocabularies), _one_aligner(vocabularies), Counter()
    own = aligner._align

    def watched(pieces):
        seen.update(pieces)
        return own(pieces)

    aligner._align = watched
    for n in range(12):
        texts = [f"always again, {' '.join(f'word{n}x{k}' for k in range(20))}", "again always", *["always a\u2581b"] * (n == 6)]
        assert aligner.align(texts) == [x and [tuple(y) for y in x] for x in plain.align(texts)]
    assert seen[" always"] == seen[" again"] == seen[" word3x7"] == 1


# 12: periodic runs


def runs_plainly(x):
    """Every (start, length, period), by comparing each word with the one q further on."""
    out, n = {}, len(x)
    for q in range(1, n // 2 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and x[e] == x[e + q]:
                e += 1
            if e - s + q >= max(12, 2 * q) and e > s and (s, e + q) not in out:
                out[s, e + q] = q
            s = e + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed_plainly(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=6), min_size=1, max_size=4))
def test_runs_against_comparison(parts):
    texts = [[w for block, times in text for w in block * times] for text in parts]
    got = periodic.runs([np.array(t, dtype=np.int64) for t in texts])
    for t, g in zip(texts, got):
        assert [tuple(r) for r in g.tolist()] == runs_plainly(t)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_long_texts(seed):
    r = np.random.default_rng(seed)
    texts = []
    for n, kinds in ((3_000, 2), (2_000, 500), (700, 1), (0, 1), (11, 1), (12, 1)):
        x = r.integers(0, kinds, n)
        for _ in range(6):
            if n > 100:
                p, times = int(r.integers(1, n // 8)), int(r.integers(2, 5))
                at = int(r.integers(0, n - p * times)) if n > p * times else 0
                x[at : at + p * times] = np.resize(x[at : at + p], len(x[at : at + p * times]))
        texts.append(x)
    for x, g in zip(texts, periodic.runs(texts)):
        assert [tuple(v) for v in g.tolist()] == runs_plainly(x.tolist())


def test_transform_is_exact():
    r = np.random.default_rng(3)
    x, y = r.integers(0, 5, (7, 8)), r.integers(0, 5, (7, 23))
    got = periodic.mismatches(x.astype(np.uint64), y.astype(np.uint64))
    want = [[int(((x[k] - y[k, d : d + 8]) ** 2).sum()) for d in range(16)] for k in range(7)]
    assert got.tolist() == want
    z = r.integers(0, periodic.PRIME, (3, 64)).astype(np.uint64)
    assert (periodic.transform(periodic.transform(z), inverse=True) == z).all()


def test_periodic_rows(spark, docs, no_docs):
    out = periodic.find(docs).select("row.doc_id", "row.text", "row.runs", "n_words", F.col("runs").alias("found"), "collapsed")
    want = Counter()
    for i, t in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = runs_plainly(words) if len(words) < 2_000 else [(0, 9_000, 401)]
        want[i, t, 1, len(words), str(found), collapsed_plainly(words, found)] += 1
    assert Counter((r[0], r[1], r[2], r[3], str([tuple(x) for x in r.found]), r.collapsed) for r in out.collect()) == want
    assert periodic.find(no_docs).count() == 0


# 13: licence scan


def licences_plainly(text, order=None, how=licenses.Scan()):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    hits = []
    for at in range(0, max(len(words) - how.window // 2, 1), how.window // 2):
        block = set(words[at : at + how.window])
        for label, t in licenses.TEMPLATES:
            own = set(re.findall("[a-z0-9]+", t.lower()))
            if words and len(own & block) >= max(how.threshold * len(own) - 1e-9, min(how.least, len(own))):
                hits.append((at, min(at + how.window, len(words)), label, len(own & block) / len(own)))
    return len(words), base, sorted(hits)


def license_texts():
    r = np.random.default_rng(5)
    filler = [f"Word{i}" for i in range(300)] + "the of to in and is this license under work".split()
    out = [t for _, t in TEXTS]
    for k in range(80):
        words = list(r.choice(filler, int(r.integers(0, 300))))
        for _ in range(int(r.integers(0, 3))):
            own = licenses.TEMPLATES[int(r.integers(len(licenses.TEMPLATES)))][1].split()
            own = [w for w in own if r.random() > 0.12]
            at = int(r.integers(0, len(words) + 1))
            words[at:at] = own
        if k % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = "ALL rights-reserved. CC BY cc by General Public\nLicense".split(" ")
        out.append((" " if k % 3 else "\n").join(words))
    return out


def test_license_join_against_all_pairs(spark, no_docs):
    texts = license_texts()
    docs = spark.createDataFrame([(i // 2 if i else None, t, "r", 1, 2, "i", 3, 4, "k", 5) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    out = licenses.scan(docs).select("row.doc_id", "row.text", "n_words", F.col("found").alias("base"), "hits").collect()
    want = Counter((i // 2 if i else None, t, str(licences_plainly(t))) for i, t in enumerate(texts))
    got = Counter((r.doc_id, r.text, str((r.n_words, [tuple(x) for x in r.base], [tuple(x) for x in r.hits]))) for r in out)
    assert got == want and sum(len(r.hits) for r in out) > 40
    assert licenses.scan(no_docs).count() == 0


def test_license_template_bounds(spark, no_docs):
    for bad in ("", "word " * 40):
        with pytest.raises(ValueError):
            licenses.scan(no_docs, templates=[("x", bad)])


# the registered queries on a small table


def test_queries_of_the_contract(spark, docs, vocabularies, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_tokenizer_spans"](spark, str(tmp_path)).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = [(i, *x[:6], digest(x[6]) if x[6] else "") for (i, _), x in zip(TEXTS, aligned_plainly([t for _, t in TEXTS], *vocabularies))]
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(want)

    got = QUERIES["op12_block_convolution"](spark, str(tmp_path)).collect()
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want, planted = [], 0
    for i, t in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            planted, g = planted + 1, h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = runs_plainly(words) if n < 2_000 else sorted({(0, n, 401)})
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want.append((
            i, len(found), *best, 1000 * best[1] // best[2] if found else None,
            digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(collapsed_plainly(words, found)),
        ))
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(want) and planted

    got = QUERIES["op13_license_join"](spark, str(tmp_path)).collect()
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = []
    for i, t in TEXTS:
        n, base, _ = licences_plainly(t)
        want.append((i, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({b for _, b in base}))))
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(want)


# 2: documents are told apart by id and text, columns may have any names


def test_passages_of_shared_and_missing_ids(spark):
    r = np.random.default_rng(9)
    text = lambda n: " ".join(f"{chr(97 + int(i) % 26)}{int(i)}" for i in r.integers(0, 5_000, n))
    shared, other, clean = text(80), text(90), text(200)
    rows = [
        (None, f"{text(30)} {shared} {text(30)}"), (None, f"{text(40)} {shared} {text(20)}"), (1, other), (2, f"{text(25)} {other}"), (2, clean), (3, clean[: len(clean) // 3]),
        (4, None), (5, ""), (5, "x " * 9_000),
    ]
    docs = spark.createDataFrame([(i, t, [1], "k", "c") for i, t in rows], "doc_id bigint, text string, __cuts array<int>, key string, cuts string").repartition(3)
    got = passages.repeats(docs).filter("removed").collect()
    assert {(g.doc_id, g.component_id) for g in got} == {(None, None), (2, 1), (3, 2)}
    left = Counter(tuple(x) for x in passages.remove_repeats(docs).select("doc_id", "text", "key").collect())
    kept = {t for _, t, _ in left}
    assert (2, clean, "k") in left and sum(shared in (t or "") for t in kept) == 1 and not any(other in (t or "") for i, t, _ in left if i == 2)
    assert passages.remove_repeats(docs).columns == docs.columns


def lines_plainly(lines, similarity=0.8):
    """Pairs of different lines whose five-word shingle sets are similar enough, by comparing all."""
    sets = {s: {tuple(s.split()[i : i + 5]) for i in range(len(s.split()) - 4)} for s in set(lines) if len(s.split()) >= 5}
    names = sorted(sets)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-12}


def test_short_lines_are_linked_without_bands_of_all(spark):
    """Lines of five words and more, with repeated words, against all pairs."""
    r = np.random.default_rng(3)
    lines = ["ab ba " * 3 + "x", "ba ab " * 3 + "x", "a b a b a b", "b a b a b a", "a a a a a", "a a a a a a", "a a a a a a a a a"]
    for n in (5, 6, 7, 8, 9, 12, 30):
        for k in range(6):
            base = [f"w{n}{k}{int(i)}" for i in r.integers(0, 400, n)]
            lines += [" ".join(base), " ".join(base[:-1]), " ".join([*base[: n // 2], "new", *base[n // 2 + 1 :]]), " ".join([*base, "tail"])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    how = passages.Passages(recall=0.999999)
    found, _ = passages.paragraphs(docs, how)
    root = {x.node: x.root for x in passages.similar_lines(docs, found, how).collect()}
    where = {lines[x.id]: root.get(x.node, x.node) for x in found.select("doc.id", "node").collect()}
    up = {s: s for s in where}

    def top(s):
        while up[s] != s:
            s = up[s]
        return s

    for a, b in lines_plainly(lines):
        up[max(top(a), top(b))] = min(top(a), top(b))
    for a in where:
        for b in where:
            assert (where[a] == where[b]) == (top(a) == top(b)), (a, b)


def test_secrets_are_masked_with_any_columns(spark):
    docs = spark.createDataFrame([(None, "password=hunter2secret end", 1, "h"), (1, None, 2, "h"), (1, "token: abcdefgh", 3, "h")], "doc_id bigint, text string, __spans int, __hash string")
    got = {r["__spans"]: r.text for r in secrets.redact(docs).collect()}
    assert got == {1: "[SECRET] end", 2: None, 3: "[SECRET]"}


def test_scan_of_many_texts_is_that_of_each(spark):
    """Lines and windows of texts read together, in batches cut by size, are those of the texts read alone."""
    r = np.random.default_rng(5)
    texts = [None, "", " \n ", "a b", "one line of five words", *[" ".join(f"w{int(i)}" for i in r.integers(0, 50, n)) for n in (24, 25, 26, 60, 900)]]
    texts += ["\n\n".join(t or "" for t in texts), "first line of the block\nsecond line of the block\n\nx"]
    found = passages.paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), passages.Passages())
    together = [Counter(map(str, t.collect())) for t in found]
    alone = [Counter(), Counter()]
    for i, text in enumerate(texts):
        for n, t in zip(alone, passages.paragraphs(spark.createDataFrame([(i, text)], "doc_id bigint, text string"), passages.Passages()), strict=True):
            n.update(map(str, t.collect()))
    assert together == alone and all(together)
    batch = pa.RecordBatch.from_pydict({"n": range(6), "text": [None, "a" * 9, "b", "c" * 30, "", "d"]})
    assert [b.num_rows for b in sized_batches(iter([batch]), 1, 4, 10)] == [3, 1, 2]


def test_windows_grow_as_far_as_each_other_document(spark):
    """A shared run of words and how far each two documents go on alike after it, against plain comparison."""
    r = np.random.default_rng(8)
    core = [f"c{i}" for i in range(60)]
    docs = {}
    for d in range(14):
        tails = [[f"t{int(i)}" for i in r.integers(0, 2, 12)] for _ in range(2)]
        docs[d] = [f"u{d}a", *tails[0], *core, *tails[1], f"u{d}b"]
    rows = [(d, " ".join(w)) for d, w in docs.items()]
    got = Counter(tuple(x) for x in passages.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "start", "end", "removed").collect())
    want = Counter()
    for d, words in docs.items():
        cut = list(np.cumsum([0] + [len(w) + 1 for w in words]))

        def span(others, words=words):
            """(first word, word behind the last) that the words share with some of the others around the core."""
            ahead = max(next(k for k in range(20) if words[12 - k] != o[12 - k]) for o in others)
            behind = max(next(k for k in range(20) if words[73 + k] != o[73 + k]) for o in others)
            return 13 - ahead, 73 + behind

        earlier = [docs[o] for o in docs if o < d]
        if earlier:
            a, b = span(earlier)
            want[d, cut[a], cut[b] - 1, True] += 1
    assert {k: n for k, n in got.items() if k[3]} == dict(want)


def test_rows_that_come_again_in_a_bucket_are_read_once(spark):
    rows = spark.createDataFrame([(b, n) for b in range(3) for n in range(40) for _ in range(5)], "bucket bigint, node bigint")
    seen = spark.sparkContext.accumulator(0)

    def verify(t, i, j):
        node = t.column("node").to_numpy()
        seen.add(int((node[i] == node[j]).sum()))
        return node[i] % 2 == node[j] % 2

    got = links.components(links.links_in_buckets(rows, verify, 2_048)).collect()
    assert seen.value == 0
    assert {(r.node, r.root) for r in got} == {(n, n % 2) for n in range(40)}


def test_lines_and_windows_do_not_stay_on_disk(spark, tmp_path):
    """Nothing reads them once the repeated ones are known; rows that are there twice change nothing."""
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(["other", *words[:59]]), "\n".join([" ".join(words[:30]), " ".join(words[30:])])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id bigint, text string")
    try:
        got = {tuple(r) for r in passages.repeats(docs).collect()}
        assert got and got == {tuple(r) for r in passages.repeats(docs.distinct()).collect()}
        tables = [f.parent for f in tmp_path.rglob("_SUCCESS")]
        assert tables and not any("keys" in spark.read.parquet(str(f)).columns for f in tables)
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before.removeprefix("file:"))


def test_a_saved_table_leaves_no_shuffle_files(spark):
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {f.name for f in local.rglob("shuffle_*")}
    before = files()
    saved = table_saved(spark.range(1_000).groupBy((F.col("id") % 10).alias("k")).count())
    assert not files() - before and saved.count() == 10


def test_stretches_share_their_words_and_marks():
    """What stands before marks is encoded once, however it is written; strings of special tokens and odd characters stay whole."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, whole = packing.WordEncoder(path), Tokenizer.from_file(path)
    marked = encoder.stretches([b"Haus haus, (HAUS)", b"", "Haus-\u00e9t\u00e9! It's A1 24".encode()])
    assert marked == [[b"haus", b"haus", b",", b"(", b"haus", b")"], [], [b"haus", b"-", "\u00e9t\u00e9".encode(), b"!", b"It's", b"a", b"1", b"24"]]
    rng = np.random.default_rng(7)
    signs = [*" \n\t ab1.,!)'<>|=", "th", "É", "×", "÷", "́", "̸", " ", "\x1c", "藏", "'s", "<|endoftext|>", "x" * 70, "İ"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 15))) for _ in range(4_000)]
    got = list(packing.encode([t.encode() for t in texts], path))
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert list(packing.encode([b"", b" \n"], path)) == [b"", b""]


def test_words_are_folded_together_and_stretches_split_once():
    """Many words at a time give what each gives alone; white space of any kind is split as in the whole text."""
    ranks = {bytes(piece): rank for piece, rank in byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))}
    rng = np.random.default_rng(5)
    letters = [bytes([b]) for b in b"  theinagrs.,1\n\xc3\xa9\xff"]
    words = [b"a", b" ", *(b"".join(rng.choice(letters, rng.integers(1, byte_bpe.SHORT))) for _ in range(3_000))]
    folded = byte_bpe.fold_many([w for w in words if w not in ranks], byte_bpe.Pairs(ranks))
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in folded] == [byte_bpe.fold_bytes(w, ranks) for w in words if w not in ranks]
    assert byte_bpe.fold_many([], byte_bpe.Pairs(ranks)) == []
    pattern = public_tokenizers.PATTERN
    reference = tiktoken.Encoding("reference", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    signs = [*"   \n\t\u00a0\u2003\x1c\x85ab1.,!'", "th", "\u00e9", "'s", "x" * 70, "\u85cf"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 15))) for _ in range(4_000)]
    for split in (pattern, pattern + "|."):  # the second is not known to allow it
        coder = byte_bpe.Coder(ranks, split)
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in coder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
        assert bool(coder.behind) == (split == pattern)
    coder = byte_bpe.Coder(ranks, pattern)
    coder.encode(["some words, some words"])
    assert set(coder.behind) == {"words,", "some", "words"} and set(coder.known) == {"some"}


def test_sets_of_lines_are_compared_by_lookup():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (1, 4), (5, 90), (90, 5), (200, 200)]:
        x, y = (rng.integers(0, 250, k).astype(np.uint64) for k in (n, m))
        a, b = passages.sorted_set(x), passages.sorted_set(y)
        assert a.tolist() == sorted(set(x.tolist())) and b.tolist() == sorted(set(y.tolist()))
        assert passages.common(a, b) == len(set(x.tolist()) & set(y.tolist()))
    top = np.array([2**64 - 1], dtype=np.uint64)
    assert passages.common(top, top) == 1 and passages.common(top - np.uint64(1), top) == 0


def test_lines_are_read_without_the_windows(spark):
    """Lines and windows lie in files of their own, and a session setting used to write them is put back."""
    texts = [(i, f"a line of its own {i}\n" + " ".join(f"w{k * 7 % 50}" for k in range(60))) for i in range(4)]
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    lines, windows = passages.paragraphs(spark.createDataFrame(texts, "doc_id bigint, text string"), passages.Passages())
    assert lines.count() == 12 and windows.count() > 0  # blocks included
    files = [{r[0] for r in t.select(F.input_file_name()).collect()} for t in (lines, windows)]
    assert all(files) and not files[0] & files[1]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == before


def test_the_smallest_keeper_stays_where_stretches_meet(spark):
    """Stretches that touch are one, with the smallest keeper of them all, whatever the numbers are; a null id counts as the smallest."""
    first, second = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    most = (1 << 63) - 1
    rows = [(most, f"{first}\n{second}"), (5, first), (-7, second), (most - 1, f"{second}\nmore words than this line needs")]
    got = passages.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("removed").collect()
    assert {(r.doc_id, r.start, r.end, r.component_id) for r in got if r.doc_id == most} == {(most, 0, len(first) + 1 + len(second), -7)}
    none = [*rows, (None, second)]
    got = passages.repeats(spark.createDataFrame(none, "doc_id bigint, text string")).filter("removed").collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(most, None), (most - 1, None), (-7, None)}
