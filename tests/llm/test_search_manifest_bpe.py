"""Ranked search, the Merkle manifest and byte-level BPE against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import lower
from pyspark.sql import functions as F
from test_training_data import DOCUMENTS, documents, folder, odd_documents_rows, same  # noqa: F401

from driftgauge.llm import fp_search, manifest, oracles, prefix_bpe, queries

RNG = random.Random(11)


# ranked search


def terms(text):
    return [w.decode() for some in fp_search.term_lists((text or "").encode()) for w in some]


def plain_search(docs, items, k=20):
    """(item_id, rank, doc_id, score) of (doc_id, text) rows and (item_id, text) rows."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    counts = [(d, Counter(split(t))) for d, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(split(t))
    out = []
    for i, words in asked.items():
        scores = []
        for d, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // max(n_all, 1)
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
                for w in words if c[w]
            )
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def test_ranked_search_is_the_plain_one(spark, folder):  # noqa: F811
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    same(queries.op11_fp_search(spark, folder).collect(), plain_search(documents(), items))


@pytest.mark.parametrize("block_terms,tree_documents", [(5, 3), (60, 40), (1 << 18, 2048)])
def test_search_with_blocks_ties_and_odd_ids(spark, block_terms, tree_documents):
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    docs = [(i, " ".join(RNG.choices(words, weights, k=RNG.randint(1, 60)))) for i in range(150)]
    docs += [(i, docs[3][1]) for i in range(200, 260)] + [(3, docs[3][1]), (None, docs[3][1]), (None, "w1 w2"), (400, None), (401, ""), (402, "!!! --")]
    items = [(i, " ".join(RNG.choices(words, k=RNG.randint(1, 12)))) for i in range(12)]
    items += [(3, "w39 w39 w1"), (None, "w0 W0 w5"), (50, None), (51, "unknown"), (52, "")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, score string, item_id int").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    same(fp_search.ranked_search(d, i, 20, block_terms, tree_documents).collect(), plain_search(docs, items))


def test_bounds_hold_and_leaves_are_skipped():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 12, 400)
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    terms_ = np.concatenate([np.sort(rng.choice(60, n, replace=False, p=np.arange(60, 0, -1) / 1830)) for n in sizes])
    tf, m = rng.integers(1, 9, ptr[-1]), rng.integers(75, 300, 400)
    tree = fp_search.DocumentTree(np.arange(400), m, ptr, terms_, tf, leaf=4)
    leaves = [n for n, c in enumerate(tree.children) if not c]
    assert sum(b - a for a, b in (tree.range[n] for n in leaves)) == 400
    item = fp_search.Item(np.asarray([0, 7, 30, 59]), np.asarray([10, 500, 3000, 9000]))
    weight = np.zeros(60, np.int64)
    weight[item.terms] = item.weights
    scores = np.add.reduceat(weight[tree.terms] * tree.factor, tree.ptr[:-1])
    for node, bound in enumerate(tree.bounds(item)):
        lo, hi = tree.range[node]
        assert scores[lo:hi].max() <= bound
    best = []
    assert 0 < tree.search(item, weight, best, 5) < len(leaves)
    order = np.lexsort((tree.ids, -scores))[:5]
    assert sorted(best, reverse=True) == [(int(scores[i]), -int(tree.ids[i])) for i in order]


def test_terms_are_cut_alike_at_any_length():
    text = ("Ünï-cödé " * 50 + "x" * 300 + " end").encode()
    whole = [w for some in fp_search.term_lists(text) for w in some]
    for limit in (1, 7, 64, 1000):
        assert [w for some in fp_search.term_lists(text, limit) for w in some] == whole


# manifest


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return hashed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(digests, fanout):
    """(top, for each leaf the (left, right) siblings level by level)."""
    paths, nodes = [[] for _ in digests], [(h, [i]) for i, h in enumerate(digests)]
    while len(nodes) > 1:
        above = []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for j, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(("".join(h for h, _ in run[:j]), "".join(h for h, _ in run[j + 1 :])))
            above.append((hashed(*[h for h, _ in run]), [i for _, below in run for i in below]))
        nodes = above
    return nodes[0][0], paths


def plain_manifest(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        trees[lang] = own, *plain_tree([leaf(r) for r in own], fanout)
    root, upper = plain_tree([trees[x][1] for x in langs], fanout)
    out = []
    for lang, above in zip(langs, upper):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            path, changed = path + above, r
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                changed = (*r[:3], r[3] + 1, r[4])
            top = leaf(changed)
            for left, right in path:
                top = hashed(left, top, right)
            out.append((r[0], leaf(r), subroot, root, hashed(*[x for s in path for x in s]), top, top == root))
    return out


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def proofs(df):
    folded = manifest.fold(F.coalesce("changed", "leaf"), F.col("path"))
    proof = manifest.digest(manifest.siblings(F.col("path")))
    return [tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", proof, folded.alias("f"), (folded == F.col("root"))).collect()]


def test_manifest_of_odd_rows(spark, folder):  # noqa: F811
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_documents_rows()]
    same(queries.op12_manifest(spark, folder).collect(), plain_manifest(rows))


@pytest.mark.parametrize("fanout,digits", [(2, 2), (3, 1), (4, 2)])
def test_manifest_over_several_tiers(spark, fanout, digits):
    rows = [(i if i % 9 else None, f"s{i % 3}", [None, "", "en", "ünï", *(f"l{j}" for j in range(9))][i % 13] if i % 2 else "en", i if i % 5 else None, f"text {i % 40}") for i in range(180)]
    rows += rows[:20] * 2
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], FIELDS + ", path string, grp string").repartition(3)
    got = proofs(manifest.manifest(df, fanout, digits))
    same(got, plain_manifest(rows, fanout))
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(7, None, None, None, None)]
    same(proofs(manifest.manifest(spark.createDataFrame(rows, FIELDS))), plain_manifest(rows))
    assert proofs(manifest.manifest(spark.createDataFrame([], FIELDS))) == []


@pytest.mark.parametrize("name", ["op11_fp_search", "op12_manifest"])
def test_sql_agrees(spark, folder, name):  # noqa: F811
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    expected = db.sql(queries.ORACLES[name])
    same(got.select(*expected.columns).collect(), expected.fetchall())
    assert oracles.MANIFEST.count("SELECT") > 5


# byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return prefix_bpe.Ranks(queries.vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=ranks.pattern.pattern, mergeable_ranks=ranks.rank, special_tokens={})


def odd_text(n):
    return "".join(RNG.choice("abcdeé  'strelv\n\t.,!0129<|>ñ中　\x1c\x85\U0001F600") for _ in range(n))


def test_bpe_of_odd_rows(spark, folder, library):  # noqa: F811
    expected = []
    for d, t in documents():
        ids = library.encode_ordinary(t or "")
        packed = np.asarray(ids, "<u4").tobytes()
        expected.append((d, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(queries.op13_prefix_bpe(spark, folder).collect(), expected)


@pytest.mark.parametrize("coarse", [None, prefix_bpe.SPACED_WORDS])
def test_bpe_is_the_library(ranks, library, coarse):
    memory = prefix_bpe.Remembered(ranks, coarse, limit=50)
    texts = [odd_text(RNG.randint(0, 80)) for _ in range(1500)] + ["a" * 3000, "ab" * 999, "the" * 700, "x " * 800, " " * 900, "\n" * 99 + "q"]
    for a in range(0, len(texts), 100):
        for text, ids in zip(texts[a : a + 100], memory.encode(texts[a : a + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_long_texts_go_bit_by_bit(ranks, library, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "LONG_TEXT", 20)
    memory = prefix_bpe.Remembered(ranks, prefix_bpe.SPACED_WORDS)
    texts = [odd_text(n) for n in (5, 300, 19, 21, 2000)]
    assert [np.frombuffer(i, "<u4").tolist() for i in memory.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_prefixes_after_appends_and_edits(ranks, library):
    for _ in range(100):
        p = prefix_bpe.Prefixes(ranks, "".join(RNG.choice("abcdethes") for _ in range(RNG.randint(0, 300))).encode())
        for _ in range(4):
            a = RNG.randint(0, len(p.piece))
            size = p.replace(a, min(len(p.piece), a + RNG.choice([0, 1, 5])), RNG.choice([b"", b"the", b"x" * 9]))
            p.append(RNG.choice([b"", b"ther", b"s"]))
            assert p.ids() == library._encode_single_piece(p.piece)
            assert p.last == prefix_bpe.Prefixes(ranks, p.piece).last
    assert size <= len(p.piece)
    long = prefix_bpe.Prefixes(ranks, b"thesecat" * 500)
    assert long.replace(1000, 1001, b"q") < 300  # not to the end


def test_texts_after_edits(ranks, library):
    for _ in range(300):
        text = prefix_bpe.EncodedText(ranks, odd_text(RNG.randint(0, 120)))
        for _ in range(3):
            a = RNG.randint(0, len(text.text))
            text.replace(a, min(len(text.text), a + RNG.choice([0, 0, 1, 5, 30])), RNG.choice(["", " ", "'", "s", "  x", "re", "é中", "\n"]))
            text.append(RNG.choice(["", " more", "s"]))
            assert text.ids() == library.encode_ordinary(text.text)


def test_edits_of_a_table(spark, ranks, library):
    import public_tokenizers

    path, pattern = queries.vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = [(1, "a text that stays"), (2, "one two three four five six seven"), (3, None), (4, "é中 don't"), (None, "no id"), (5, "")]
    edits = [(2, 4, 7, "zwei"), (2, 33, 33, " eight"), (3, 0, 0, "new"), (4, 1, 2, "'s"), (9, 0, 0, "nothing"), (None, 0, 1, "x"), (5, 0, 0, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    coded = prefix_bpe.encode(table, path, pattern)
    changed = prefix_bpe.apply_edits(
        table.join(coded, table["doc_id"].eqNullSafe(coded["doc_id"])).select(table["doc_id"], "text", "ids"),
        spark.createDataFrame(edits, "doc_id long, start int, end int, new string"), path, pattern,
    ).collect()
    texts = {1: docs[0][1], 2: "one zwei three four five six seven eight", 3: "new", 4: "é's don't", None: "no id", 5: ""}
    assert {r.doc_id: r.text for r in changed} == texts
    for r in changed:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids) // 4
    assert {r.doc_id: r.encoded_again for r in changed}[1] == 0
    assert {r.doc_id: r.encoded_again for r in changed}[2] <= 3


def test_decoding_inverts_and_rejects_unknown_ids(spark):
    import public_tokenizers

    path, pattern = queries.vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = prefix_bpe.encode(spark.createDataFrame([(1, "naïve — text"), (1, "naïve — text"), (2, None)], "doc_id long, text string"), path, pattern)
    assert sorted(bytes(r.decoded).decode() for r in prefix_bpe.decode(coded, path, pattern).collect()) == ["", "naïve — text", "naïve — text"]
    bad = spark.createDataFrame([(1, 1, np.asarray([1 << 20], "<u4").tobytes())], "doc_id long, n_tokens long, ids binary")
    with pytest.raises(Exception, match="IndexError"):
        prefix_bpe.decode(bad, path, pattern).collect()


def test_short_rank_file(spark, tmp_path):
    """A vocabulary with tokens that merging can't reach: only a match of its own is such a token."""
    import base64

    import tiktoken

    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abcd", b"xyz"]
    path = tmp_path / "small.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    small = prefix_bpe.Ranks(str(path), r"\w+|\W+")
    library = tiktoken.Encoding("small", pat_str=r"\w+|\W+", mergeable_ranks=small.rank, special_tokens={})
    for text in ("abcd", "xabcd", "abcdabcd", "xyz", "xyzxyz", "abc bc ab", "aabbcc"):
        assert [i for p in small.pattern.findall(text) for i in small.encode_piece(p.encode())] == library.encode_ordinary(text)


def test_batches_of_arrow_keep_rows():
    batch = pa.record_batch({"doc_id": pa.array([1, None], pa.int64()), "n_terms": pa.array([0, 0]), "terms": pa.array([b"", b""]), "tf": pa.array([b"", b""])})
    assert list(fp_search.trees_of([batch], np.zeros(0, np.int64), 0, 0, 4)) == []
