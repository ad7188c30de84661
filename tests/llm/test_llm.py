"""The corpus operators: brute-force versions, exact round trips, and rows with nulls, empties, ties and repeats."""

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann, mixing, neardup, pieces, quality, tokenfiles, topk, toxicity, vectors, warc
from loomgraph.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "a", "  two  spaces ", "line\nbreak\n\nx", "▁mark ▁", "日本語 🙂", "\t\x0b tab", "word " * 3000, "x" * 500, "The end."]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i else None, t, "en", None if i % 3 == 0 else f"s{i % 2}", 0) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], rows[5]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_targets_share_and_stop(spark):
    units = spark.createDataFrame([("a", 10, 1), ("b", 100, 3), (None, 50, 2), ("z", 0, 4)], "source string, size long, n long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(units).collect()}
    total = 10 + 300 + 100
    assert got["a"] == 20.0 and got["z"] == 0.0  # weights 5, 2, 5 (z comes third: 1; null last: 5)
    assert got["b"] + got[None] == pytest.approx(1.5 * total - 20)
    assert got[None] == 200.0 and got["b"] == pytest.approx(1.5 * total - 220)


def test_mix_keeps_words_and_limits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", f"s{i % 4 if i % 3 else 0}", 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_rows(docs, mixing.word_count(F.col("text"))).collect()
    again = mixing.mix_rows(docs.repartition(7), mixing.word_count(F.col("text"))).collect()
    assert sorted((r["id"], r["taken"]) for r in got) == sorted((r["id"], r["taken"]) for r in again)
    assert len(got) == 1500 and all(r["taken"] <= 2 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60


def test_mix_odd_rows(spark, odd, empty):
    rows = mixing.mix_rows(odd, mixing.word_count(F.col("text"))).collect()
    assert len(rows) == odd.count()
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix_rows(empty, mixing.word_count(F.col("text"))).count() == 0


def test_pieces_equal_the_library(spark, odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.encoded(odd, MODEL, with_ids=True, keep=["lang"]).collect()
    want = [library.encode(r["text"] or "") for r in odd.collect()]
    assert Counter(tuple(r["ids"]) for r in got) == Counter(map(tuple, want))
    for r in got:
        assert r["decoded"] == (library.decode(r["ids"]) if r["ids"] else "")
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() and r["n_tokens"] == len(r["ids"])
    assert pieces.encoded(empty, MODEL).count() == 0


def test_long_and_short_agendas_agree():
    with open(MODEL, "rb") as f:
        p = pieces.Pieces(f.read())
    for text in ("▁international", "▁aaaaaaaaaaaaaaaa", "▁öäüß日本", "▁ththththth"):
        assert p.merged(list(text)) == p.merged_short(list(text))


def test_agendas_together_are_those_of_each_word(monkeypatch):
    """Words of all lengths, worked out together, have the ids that each has alone: those with characters that are no piece, too."""
    monkeypatch.setattr(pieces, "TOGETHER", 7)
    with open(MODEL, "rb") as f:
        p = pieces.Pieces(f.read())
    rng = np.random.default_rng(8)
    words = ["▁" * (i % 2) + "".join(rng.choice(list("aeinorstthlé日\t🙂\u0378"), 1 + i % 50, p=[0.065] * 15 + [0.025])) for i in range(400)]
    words += ["▁", "\n", "", "aaaaaaaa", "▁international", "\U0010ffff"]
    ids, counts = p.worked_out(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [p.agenda(w) for w in words]
    assert [len(x) for x in p.worked_out([])] == [0, 0]
    p.encode_texts(["some words", "more\nwords"])
    monkeypatch.setattr(p, "worked_out", lambda w, f=p.worked_out: (f(w)[0] + 1, f(w)[1]))
    with pytest.raises(ValueError, match="unmet"):
        p.encode_texts(["words unmet"])


def test_token_files(spark, odd, empty):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = new_path(spark, "tokens")
    tokenfiles.write_token_files(odd, path, RANKS, public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], len(encoding.encode_ordinary(r["text"] or ""))) for r in odd.collect())
    for block in (1 << 20, 50, 7):
        assert Counter((r["doc_id"], r["n_tokens"]) for r in tokenfiles.token_counts(spark, path, block=block).collect()) == want
    tokenfiles.write_token_files(empty, nothing := new_path(spark, "none"), RANKS, public_tokenizers.PATTERN)
    assert tokenfiles.token_counts(spark, nothing).count() == 0


def test_token_file_above_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "long.txt", "wb") as f:  # sparse: a document of identifiers 1, ended, far behind one never ended
        f.write(np.array([*[1] * 15, 8, 5, 5, 0], "<u2").tobytes())
        f.seek(2**31 + 10)
        f.write(np.array([0, *[1] * 15, 10, 5], "<u2").tobytes())
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    ranges = {r["block"]: r for r in tokenfiles.byte_ranges(files.select("path", "length")).collect()}
    assert sorted(ranges) == list(range(1025)) and max(r["length"] for r in ranges.values()) < 2**21 + 100
    ends = tokenfiles.block_summaries(files.filter("length > 0"), separator=5, header=0)[1].selectExpr("explode(at) as at").collect()
    assert sorted(r["at"] for r in ends) == [16, 17, 2**30 + 5 + 17]
    assert [(r["start"], r["n_tokens"], r["ended"]) for r in tokenfiles.token_counts(spark, f"file://{tmp_path}", separator=5, header=0).orderBy("start").collect()] == [(0, 16, True), (17, 0, True), (18, 2**30 + 4, True)]


def test_long_token_files_stitch_by_spans(spark, monkeypatch):
    path = new_path(spark, "tokens")
    docs = spark.createDataFrame([(i, "word " * (700 if i % 5 == 0 else i), "en", "s", 0) for i in range(12)], DOCS)
    tokenfiles.write_token_files(docs.coalesce(1), path, RANKS, public_tokenizers.PATTERN)
    rows = lambda **o: sorted(tuple(r) for r in tokenfiles.token_counts(spark, path, **o).collect())
    want = rows()
    monkeypatch.setattr(tokenfiles, "SPAN", 4)
    assert len(want) == 12 and rows(block=16) == want
    monkeypatch.setattr(tokenfiles, "reads_ranges", lambda files: False)
    assert rows(block=16) == want


def test_archives(spark):
    trap = "<p>WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n é"
    rows = [(1, "u", trap), (2, None, None), (3, "a\r\nb", ""), (4, "z", "é日本"), (None, "q", "é日本"), (4, "z", "é日本"), (7, "w", trap)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_archives(pages.coalesce(1), path)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kind = [("response", None), ("response", None), ("revisit", 2), ("response", None), ("revisit", 4), ("revisit", 4), ("revisit", 1)]
    assert got == Counter((i, len((h or "").encode()), digest(h), *k) for (i, _, h), k in zip(rows, kind, strict=True))
    warc.write_archives(pages.limit(0), none := new_path(spark, "none"))
    assert warc.read_archives(spark, none).count() == 0
    headers = [r["value"].split("\r\n\r\n")[0].split("\r\n")[1:] for r in warc.record(warc.with_roles(pages)).collect()]
    fields = [dict(line.split(": ", 1) for line in h) for h in headers]
    assert all({"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= f.keys() for f in fields)
    ids = {f["WARC-Record-ID"]: f for f in fields}
    assert len(ids) == len(rows)
    for f in fields:
        if f["WARC-Type"] == "revisit":
            held = ids[f["WARC-Refers-To"]]
            assert (held["WARC-Type"], held["WARC-Payload-Digest"], held.get("X-Page-ID")) == ("response", f["WARC-Payload-Digest"], f.get("X-Refers-To-Page-ID"))


@pytest.mark.parametrize("ranged", [True, False])
def test_archives_by_ranges(spark, monkeypatch, ranged):
    import time

    monkeypatch.setattr(warc, "RANGE_BYTES", 3000)
    monkeypatch.setattr(warc, "MORE_BYTES", 700)
    if not ranged:
        monkeypatch.setattr(warc, "reads_ranges", lambda files: False)
    rng = np.random.default_rng(8)
    trap = "WARC/1.0\r\nContent-Length: {}\r\n\r\n"
    rows = [(i, "u" * int(rng.integers(0, 900)), "".join(trap.format(int(rng.integers(0, 3000))) + "x" * int(rng.integers(0, 900)) for _ in range(int(rng.integers(0, 6))))) for i in range(60)]
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path, least_bytes=1 << 30)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(spark, path).collect())
    assert got == [(i, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in rows]
    monkeypatch.undo()
    many = "WARC/1.0\r\n" * 100_000
    warc.write_archives(spark.createDataFrame([(1, "u", many), (2, "v", "x")], "page_id long, url string, html string").coalesce(1), path := new_path(spark, "warc"))
    start = time.time()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in warc.read_archives(spark, path).collect()) == [(1, len(many)), (2, 1)]
    assert time.time() - start < 120


def test_archives_are_cut_by_bytes(spark, monkeypatch):
    import glob
    import os

    monkeypatch.setattr(warc, "SMALL_BYTES", 1 << 10)
    monkeypatch.setattr(warc, "RECORDS_A_FILE", 16)
    rows = [(i, "u", f"{i}" + "x" * (200 if i % 3 else 6000)) for i in range(90)]
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    assert max(map(os.path.getsize, glob.glob(f"{path.removeprefix('file://')}/*.txt"))) < 2 * 16 * (1 << 10)
    assert sorted(r["page_id"] for r in warc.read_archives(spark, path).collect()) == list(range(90))


def _vectors(spark, n=400, d=8):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(d)]) for i in range(n)]
    rows += [(n, None), (None, rows[0][1]), (n + 1, [float("nan")] * d), (n + 2, [None] * d), (n + 3, rows[5][1]), (n + 4, rows[5][1]), (7, rows[7][1]), (n + 5, [1.0] * 3), (n + 6, [0.0] * d)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {i: v for i, v in rows if i is not None and v and None not in v and v[0] == v[0]}


def test_exact_top_k(spark):
    df, real = _vectors(spark)
    ints = {i: np.floor(np.array(v) * 1024).astype(int) for i, v in real.items()}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(df, every=20).collect()}
    want = {}
    for q in ints:
        if q % 20 == 0:
            best = sorted(((-int(ints[q] @ x), i) for i, x in ints.items() if i != q and len(x) == len(ints[q])))[:10]
            want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_segment_bound_is_a_bound():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((50, 13)), rng.standard_normal((20, 13))
    for s in (1, 4, 16):
        assert (vectors and topk.statistics(q, s) @ topk.statistics(x, s).T >= q @ x.T - 1e-9).all()


def test_nearest_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.7 * rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df).collect()
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    hit = 0
    for r in got:
        c = u @ u[r["query_id"]]
        c[r["query_id"]] = -9
        hit += r["vec_id"] in np.argsort(-c)[:5]
        assert r["score"] == pytest.approx(c[r["vec_id"]], abs=1e-12)
    assert len(got) == 300 and hit / 300 >= 0.9
    # Parts that are cut again, two to four at a level.
    levels = ann.fit_levels(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 3000, sample=1000, leaf_rows=100)
    assert [len(x) for x in levels][:2] == [1, 4]
    seen = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, sample=1000, leaf_rows=100).collect()}
    exact = {(q, int(v)) for q in range(0, 3000, 50) for v in [i for i in np.argsort(-(u @ u[q])) if i != q][:5]}
    assert len(seen) == 300 and len(seen & exact) / 300 >= 0.9
    small, real = _vectors(spark, 60)
    assert {r["query_id"] for r in ann.nearest(small).collect()} == {0, 50}
    assert ann.nearest(small.limit(0)).count() == 0


def _bag(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else None


def test_near_duplicates_equal_brute_force(spark, empty):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(int(rng.integers(3, 120)))]
        texts.append(base)
        for _ in range(int(rng.integers(0, 6))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = word()
            texts.append(copy)
    texts += [["same"] * 500, ["same"] * 450, ["same"] * 300, [], ["one"], ["ONE"]]
    rows = [(i, "  ".join(t), "en", "s", 0) for i, t in enumerate(texts)] + [(None, "one", "en", "s", 0), (len(texts), None, "en", "s", 0)]
    bags = {i: _bag(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                both = sum((bags[a] & bags[b]).values())
                if 5 * both >= 4 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got.pop(None) is None and got == {i: find(i) for i in bags}
    kept = neardup.deduplicated(docs.unionByName(docs.limit(3)))
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted({find(i) for i in bags})
    assert neardup.near_duplicates(empty).count() == 0


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    a, b = rng.integers(1, 30, 200), rng.integers(1, 30, 200)
    s = neardup.bag_min_hash([(x, a), (x, b)], m=4096)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def _labelled(spark, n=400):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 8)))) for _ in range(60)]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            words[int(rng.integers(0, 60))] = "vilest"
        text = " ".join(w.upper() + "!!" if junk else w for w in words) + ". Fine words end it."
        rows.append((i, text, "en", "s", 0))
        labels.append((i, 0 if junk else 1, int(toxic and not junk)))
    return spark.createDataFrame([*rows, (n, None, "en", "s", 0), (None, "", "en", "s", 0)], DOCS), spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def test_quality_and_toxicity_held_out(spark, empty):
    docs, labels = _labelled(spark)
    truth = {r["doc_id"]: r for r in labels.filter("doc_id is not null and quality is not null").collect()}
    q = quality.classified(docs, labels).collect()
    assert len(q) == docs.count()
    assert np.mean([(r["tail_probability"] >= 0.5) == (truth[r["doc_id"]]["quality"] == 1) for r in q if r["doc_id"] in truth]) > 0.97
    t = toxicity.score_toxicity(docs, toxicity.fitted(docs, labels), spans=True).collect()
    assert np.mean([(r["toxicity"] >= 0.3) == (truth[r["doc_id"]]["toxic"] == 1) for r in t if r["doc_id"] in truth and truth[r["doc_id"]]["quality"]]) > 0.97
    bad = [r for r in t if r["toxicity"] > 0.5 and r["offending"]]
    assert bad and all("vilest" in r["text"][s["start"] : s["end"]].lower() for r in bad for s in r["offending"])
    assert quality.classified(empty, labels.limit(0)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fitted(empty, labels)).count() == 0


def test_quality_grades_differ_by_words(spark):
    docs, labels = _labelled(spark)
    grade = {r["id"]: r["grade"] for r in quality.graded(labels).collect()}
    held = quality.classified(docs, labels).filter(quality.crc_mod(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT).collect()
    toxic, sound = ([r["expected_grade"] for r in held if grade.get(r["doc_id"]) == g] for g in (1, 2))
    assert len(toxic) > 10 and len(sound) > 40
    assert np.mean(np.array(toxic)[:, None] < np.array(sound)[None, :]) > 0.9


def test_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 200)
    x = [(np.array([int(g), 10]), np.array([1.0, rng.random()], dtype=np.float32)) for g in grades]
    _, cut = quality.fit_cumulative(x, grades, n_grades=4)
    assert (np.diff(cut) > 0).all()
