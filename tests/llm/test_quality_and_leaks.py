import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import contamination as C
from paperloom.llm import mixing as M
from paperloom.llm import quality as Q

PROSE = "The vessel was examined on board and no open item remains. It is recommended that the plan be checked again within ten days.\nThe reader should note that this depends on the survey, as explained below."
LIST = "A title of ours\n" + "\n".join(f"- the item number {i}" for i in range(12))
TABLE = "Ref\tQty\tUnit\n" + "\n".join(f"{i}\t{i * 7}.5\tn/a" for i in range(12))
JUNK = "xkcd qwrtp lkjhg mnbvc zxcvb plmkn qzwsx rfvtg bnhyt " * 5
PLAIN = "\n".join(f"The purchase order x{i}" for i in range(8))


def test_kinds(spark):
    rows = [(1, PROSE), (2, LIST), (3, TABLE), (4, JUNK), (5, PLAIN), (6, None), (7, ""), (8, "short"), (9, "x" * 70), (10, "| 1 | 2 |\n" * 20), (11, PROSE), (12, PROSE + "\n" + "- one entry of a list")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word_count", F.lit("clash"))
    got = {r.doc_id: r for r in Q.text_statistics(df).collect()}
    kinds = {k: r.text_kind for k, r in got.items()}
    assert kinds == {1: "prose", 2: "list", 3: "table", 4: "junk", 5: "list", 6: None, 7: None, 8: None, 9: "junk", 10: "table", 11: "prose", 12: "prose"}
    assert got[6].word_count == 0 and got[6].mean_word_length is None and got[1].word_count == len(PROSE.split())
    assert Q.text_statistics(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_chunks_merge_to_the_whole():
    rng = random.Random(5)
    for text in (PROSE, LIST, TABLE, JUNK, PLAIN, "a\n\nb", "\n", "one", PROSE.replace("\n", " ") * 3):
        whole = Q.finish(Q.chunk_state(text))
        for n in (3, 7, 40, 90):
            states = [Q.chunk_state(text[i : i + n], text[i - 1] if i else "", text[i + n : i + n + Q.LOOKAHEAD]) for i in range(0, len(text), n)]
            while len(states) > 1:  # any order of merging neighbours
                i = rng.randrange(len(states) - 1)
                states[i : i + 2] = [Q.merge_states(states[i], states[i + 1])]
            assert np.allclose(Q.finish(states[0])[[0, 1, 2, 4, 5]], whole[[0, 1, 2, 4, 5]]), (text[:20], n)


def test_every_total_is_the_same_for_any_chunking():
    rng = random.Random(8)
    lines = ["x" * 300, "(iv)    An entry of a list", "[ ] a box", "[  ] no box", "#123456789   an item", "  12.   it ends.  ", 'He said "so."  ', "so. '' ' ", "so.' ", "a   b     c", "   ", "ab ab ab ab ab ab ab ab", "the the the the the the the", "abab" * 9 + "      ab", "asdf" * 12, "A PLAIN LINE", "A plain line", "1 2 3 n/a 5.5", "", "one, two, three; four", "\t- x"]
    texts = lines + ["\n".join(rng.choice(lines) for _ in range(8)) for _ in range(40)] + ["".join(rng.choice("ab .'-\n\t1") for _ in range(60)) for _ in range(200)]
    for text in texts:
        whole = Q.finish(Q.chunk_state(text))
        by_line = np.zeros(len(Q.TOTALS))
        for line in text.split("\n"):
            Q._close(by_line, Q._features(line), line.rstrip().rstrip("\"'”’)»").endswith(tuple(".!?…:;")), Q._repeated(line))
        assert np.array_equal(whole, by_line), text
        for n in (1, 2, 3, 7, 40, 90):
            states = [Q.chunk_state(text[i : i + n], text[i - 1] if i else "", text[i + n : i + n + Q.LOOKAHEAD]) for i in range(0, len(text), n)] or [Q.chunk_state("")]
            while len(states) > 1:
                i = rng.randrange(len(states) - 1)
                states[i : i + 2] = [Q.merge_states(states[i], states[i + 1])]
            assert np.array_equal(Q.finish(states[0]), whole), (text, n, dict(zip(Q.TOTALS, Q.finish(states[0]) - whole)))


def test_one_long_token_counts_whole(spark):
    row = Q.text_statistics(spark.createDataFrame([(1, "x" * 200_000)], "doc_id bigint, text string")).first()
    assert row.word_count == 1 and row.mean_word_length == 200_000 and row.text_kind == "junk"


def test_huge_text_through_rounds(spark):
    df = spark.createDataFrame([(1, (PROSE + "\n") * 400), (2, LIST)], "doc_id bigint, text string")
    a = {r.doc_id: r for r in Q.text_statistics(df, chunk=500).collect()}
    b = {r.doc_id: r for r in Q.text_statistics(df).collect()}
    assert a[1].word_count == b[1].word_count == len(PROSE.split()) * 400 and a[1].line_count == b[1].line_count and a[1].text_kind == "prose" and a[2].text_kind == "list"


def brute(docs, items, run):
    out = set()
    for d, text in docs:
        w = C.words_of(text)
        for i, t in items:
            b = C.words_of(t)
            grams = {tuple(b[k : k + run]) for k in range(len(b) - run + 1)}
            if any(tuple(w[k : k + run]) in grams for k in range(len(w) - run + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(6)] + [(6, None), (7, ""), (8, "short one")]
    docs = [(-1, None), (-2, ""), (-3, "Ünïcode İ text")]
    for d in range(150):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        if d % 2:
            b = C.words_of(rng.choice(items[:6])[1])
            n = rng.choice([10, 11, 12, 13, 30])
            at = rng.randrange(len(b) - n)
            text[rng.randrange(len(text)) : 0] = [w.upper() + rng.choice(["", ",", "*"]) for w in b[at : at + n]]
        docs.append((d, " ".join(text)))
    frame = spark.createDataFrame([*docs, docs[5]], "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in C.leaks(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == brute(docs, items, C.RUN) and got
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    joined = C.leaks(frame, bench, most=0)  # as for a benchmark too large to broadcast
    assert {tuple(r) for r in joined.distinct().collect()} == {tuple(r) for r in C.leaks(frame, bench).distinct().collect()}
    a, b = ({(r.doc_id, r.text, r.removed_words) for r in C.cleaned(frame, bench, most=n).collect()} for n in (0, C.INDEX_WORDS))
    assert a == b and sum(r[2] > 0 for r in a) == len({d for d, _ in got})
    assert C.leaks(frame.limit(0), bench, most=0).count() == 0
    none = C.leaks(frame, spark.createDataFrame([], "item_id bigint, text string"))
    assert none.count() == 0 and C.leaks(frame.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def test_spans_are_removed():
    index = C.build_index([(1, " ".join(f"t{i}" for i in range(20)))])
    text = "Before it, " + " ".join(f"T{i}" for i in range(14)) + "! After it."
    spans = [s[1:] for s in C.spans_of(text, index)]
    assert spans == [(2, 16)] and C.remove_spans(text, spans) == "Before it, ! After it."


def test_cut_mean_and_thresholds():
    for rate, cap in [(0.1, 1), (0.7, 2), (1.9, 3), (2.5, 4)]:
        lam = M.poisson_mean(rate, cap)
        assert M.cut_mean(lam, cap) == pytest.approx(rate, abs=1e-9)
        steps = M.thresholds(rate, cap)
        assert sum(1 - s for s in steps) == pytest.approx(rate, abs=1e-6) and steps == sorted(steps) and len(steps) == cap
    assert M.thresholds(2.0, 2) == [0.0, 0.0]


def test_mixture(spark):
    rows = [(i, f"alpha beta gamma {i}", "big" if i % 3 else "small") for i in range(3000)] + [(9001, None, "big"), (9002, "", "small"), (9003, "no source", None), (9004, "other text", "untargeted")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("missing", 0.0, 3)], "source string, target_share double, max_repeats int")
    out = M.mixed(spark, docs, targets)
    shares = {r.source: r.n for r in out.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert set(shares) == {"big", "small"} and abs(shares["big"] / sum(shares.values()) - 0.5) < 0.03
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert [r.place for r in out.select("place").collect()] == sorted(r.place for r in out.select("place").collect())
    assert out.count() == M.mixed(spark, docs.repartition(7), targets).count()  # the seed, not the layout, decides
    assert M.mixed(spark, docs.limit(0), targets).count() == 0


def test_pieces_go_through_rounds_of_merging(spark):
    rows = [(1, (PROSE + "\n") * 300), (2, LIST), (3, (TABLE + "\n") * 200), (4, "word " * 30_000), (5, None), (6, (LIST + "\n") * 200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r.doc_id: r for r in Q.text_statistics(df, chunk=1 << 20).collect()}
    for chunk, piece in ((997, 5000), (64, 1 << 20), (4096, 4096)):
        got = {r.doc_id: r for r in Q.text_statistics(df, chunk=chunk, piece=piece).collect()}
        assert got == want, (chunk, piece)
    assert want[1].text_kind == "prose" and want[3].text_kind == "table" and want[6].text_kind == "list"
