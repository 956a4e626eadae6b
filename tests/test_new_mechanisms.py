"""Mechanisms against plain versions: likeness joins, places of quotes, shapes of answers, ingestion, memory with timers, pieces, hops."""

from __future__ import annotations

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.functions.fuzzy import lcs_length, lcs_lengths, ratio_of
from siftstone.functions.places import normal, span
from siftstone.operators import answers, bm25, chunking, evaluation, grounding, hierarchy, messages, metrics, shapes, terms
from siftstone.operators.likeness import alike
from siftstone.plans import retrieval
from siftstone.sources import scratch
from siftstone.streaming import ingestion, timers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [33.3, 60, 80, 85, 100])
def test_likeness_finds_all_pairs(spark, least):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(14)))

    def near(s):
        s = list(s)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(s) + 1)
            if rng.random() < 0.5 and s:
                s.pop(k - 1)
            else:
                s.insert(k, rng.choice("abcdé"))
        return "".join(s)

    a = [word() for _ in range(80)]
    b = [near(x) for x in a] + [word() for _ in range(50)] + ["x" * 40, "a" * 40]
    a += ["x" * 38 + "yy", "a" * 44]
    df = alike(spark.createDataFrame([*((x,) for x in a), (None,)], "a string"), spark.createDataFrame([*((x,) for x in b), (None,)], "b string"), "a", "b", least)
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    assert {(r.a, r.b) for r in df.collect()} == {(x, y) for x in set(a) for y in set(b) if ratio_of(x, y) >= least}


def _sentences(rng, n, words=60, long=30):
    known = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(words)]
    return [" ".join(rng.choice(known) for _ in range(long)) for _ in range(n)]


def test_likeness_moves_strings_and_not_pairs(spark):
    """Strings that share most of their pairs of neighbours, but are not alike: a few times their bytes are shuffled, however many pairs there are."""
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    rng = random.Random(5)
    texts = [_sentences(rng, 1200) for _ in "ab"]
    both = [spark.createDataFrame([(x,) for x in side], f"{name} string") for name, side in zip("ab", texts, strict=True)]
    before = shuffled()
    assert alike(*both, "a", "b", 85).count() == 0
    time.sleep(1)
    assert shuffled() - before < 6 * sum(len(x) for side in texts for x in side)


def test_most_alike_finds_the_best_of_all_pairs_over_blocks(spark, monkeypatch):
    from siftstone.operators import likeness

    monkeypatch.setattr(likeness, "LEFT", 11)
    monkeypatch.setattr(likeness, "RIGHT", 40)
    rng = random.Random(11)
    given = _sentences(rng, 120)
    given += [x[:k] + x[k + 5 :] for x in given[:40] for k in (3, 40)] + [given[0][:k] + "\U0001f600" + given[0][k:] for k in range(40)] + ["", "q", "qq"]
    asked = [x[2:60] + x[66:] for x in given[:70]] + given[100:110] + _sentences(rng, 10) + ["", "q", "z", "qqq"]
    for least in (60, 85):
        df = likeness.most_alike(spark.createDataFrame([*((x,) for x in asked), (None,)], "a string"), spark.createDataFrame([*((x,) for x in given), (None,)], "b string"), "a", "b", least)
        want = set()
        for x in set(asked):
            best = max(ratio_of(x, y) for y in given)
            want |= {(x, y, best) for y in given if best >= least and ratio_of(x, y) == best}
        assert {tuple(r) for r in df.collect()} == want and len(want) > 70


def test_lengths_of_many_common_subsequences():
    rng = random.Random(3)
    code = lambda s: np.array([ord(x) for x in s], "<u4")
    for n in (1, 62, 63, 64, 126, 300):
        a = "".join(rng.choice("abcé\U0001f600") for _ in range(n))
        others = ["".join(rng.choice("abcéx") for _ in range(rng.randrange(200))) for _ in range(30)] + [a, a[1:], ""]
        assert lcs_lengths(code(a), [code(b) for b in others]).tolist() == [lcs_length(a, b) for b in others]


def test_entities_meet_by_stretches(spark):
    """The same as every query with every entity."""
    rng = random.Random(2)
    parts = ["alpha", "be", "gunner", "tiger", "ox", "the", "leader", "omega", "zz"]
    names = [(" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))), f"t{k % 7}") for k in range(60)]
    queries = [(k, " ".join(rng.choice([*parts, "xalphax", "leaders", "be gunner", "tige"]) for _ in range(5))) for k in range(30)]
    table = terms.entity_table(spark.createDataFrame(names, "name string, team string"), "name", "team")
    q = spark.createDataFrame(queries, "id long, text string")
    for rule in (terms.names_match, terms.abilities_match):
        all_pairs = table.crossJoin(q.select("id", F.lower("text").alias("_q"))).where(rule(F.col("_q"))).select("id", F.explode("teams").alias("team")).distinct()
        want = {r.id: sorted(r.t) for r in all_pairs.groupBy("id").agg(F.collect_list("team").alias("t")).collect()}
        got = terms.matched_teams(q, table, "id", "text", rule)
        assert {r.id: r.teams for r in got.collect()} == want and "NestedLoop" not in plan(got)


# -- places --------------------------------------------------------------------------------


def plain_span(quote, text):
    """Every window from the left, the shortest first."""
    for s in range(len(text)):
        for n in range(1, min(3 * len(quote), len(text) - s) + 1):
            if normal(text[s : s + n])[0] == quote:
                return s, s + n
    return None


def test_places_of_quotes():
    rng, found = random.Random(1), 0
    for _ in range(1500):
        text = "".join(rng.choice(["Ab", "c", "`h`", "...", "[...]", "İx", "…", "k"]) + rng.choice([" ", "  ", "\n\t ", ""]) for _ in range(rng.randrange(1, 9)))
        form, places = normal(text)
        assert len(form) == len(places) and (places[1:] >= places[:-1]).all()
        if len(form) < 4:
            continue
        a = rng.randrange(len(form) - 2)
        quote = form[a : rng.randrange(a + 2, len(form) + 1)].strip()
        want = plain_span(quote, text) if len(quote) > 2 else None
        if want:
            found += 1
            assert span(quote, text) == want
    assert found > 300
    assert span("x y", "**x  y** z") == (0, 8) and span("y z", "**x  y** z") == (5, 10) and span("q", "abc") is None


def test_located_quotes(spark):
    quotes = spark.createDataFrame([(1, "the Cat [...] dog", "k"), (2, "bird", "k"), (3, "", "k")], "q long, quote string, key string")
    texts = spark.createDataFrame([("a", "k", "See the  **cat** and the dog. " + "x" * 200), ("b", "k", None), ("c", "other", "bird")], "t string, key string, text string")
    got = {(r.q, r.part): (r.source, r.start, r.end, r.shown) for r in grounding.located(quotes, texts, "q", "quote", "key", "t", "text").collect()}
    assert got[1, 0][:3] == ("a", 3, 16) and got[1, 1][0] == "a" and len(got[1, 1][3]) == got[1, 1][2] - got[1, 1][1] + 100
    assert set(got) == {(1, 0), (1, 1)}


# -- shapes --------------------------------------------------------------------------------

GOOD = {"smalltalk": False, "short_answer": "a", "persona_short_answer": "b", "quotes": [{"quote_title": "t", "quote_text": "x"}], "explanation": "", "persona_afterword": "c"}


def plain_faults(text):
    try:
        data = json.loads(text)
    except (json.JSONDecodeError, TypeError):
        return ["json"]
    missing = [x for x in shapes.FIELDS if not isinstance(data, dict) or x not in data]
    if missing:
        return [f"missing:{x}" for x in missing]
    quotes = data["quotes"]
    if isinstance(quotes, str):
        try:
            quotes = json.loads(quotes.rstrip().rstrip(","))
        except json.JSONDecodeError:
            return ["quotes:json"]
    if not isinstance(quotes, list):
        return ["quotes:list"]
    lacking = [f"quote:{k}" for k, q in enumerate(quotes) if not isinstance(q, dict) or "quote_title" not in q or "quote_text" not in q]
    bad = lambda x: not isinstance(x, str) or not x.strip()
    return lacking or [f"blank:{x}" for x in shapes.FILLED if bad(data[x])] + [f"blank:{k}:{x}" for k, q in enumerate(quotes) for x in shapes.QUOTE_FIELDS if bad(q[x])]


def test_shapes_of_answers(spark):
    rng, texts = random.Random(4), [None, "", "[]", "3", "null", '"x"', json.dumps(GOOD), json.dumps(GOOD)[:-1]]
    values = [None, "", "  ", "x", 3, [], {}, [1], [GOOD["quotes"][0]], [{"quote_title": "t"}], [{"quote_title": None, "quote_text": "x"}], "[]", "[] , ", "[", '{"a": 1}', json.dumps(GOOD["quotes"]), True]
    for _ in range(200):
        some = dict(GOOD)
        for _ in range(rng.randrange(1, 3)):
            name = rng.choice(shapes.FIELDS)
            if rng.random() < 0.3:
                some.pop(name, None)
            else:
                some[name] = rng.choice(values)
        texts.append(json.dumps(some))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, json string")
    rows = answers.parsed(df, "json").collect()
    assert {r.i: r.faults for r in rows} == {k: plain_faults(x) for k, x in enumerate(texts)}
    assert all(r.valid == (r.faults == []) for r in rows)


def test_keys_are_cut(spark):
    df = spark.createDataFrame([('{"b": {"persona_afterword": 1}, "persona_afterword": 2, "a": [null, 1.5]}',), ("no json",), ("[1]",), (None,)], "j string")
    got = [r.j for r in df.select(shapes.for_judge(F.col("j")).alias("j")).collect()]
    assert json.loads(got[0]) == {"a": [None, 1.5], "b": {"persona_afterword": 1}} and got[1:] == ["no json", "[1]", None]


def test_a_key_given_twice_counts_once(spark):
    scores = spark.createDataFrame([("t", "a", 1.0), ("t", "b", 0.0)], "test string, key string, score double")
    given = spark.createDataFrame([("t", "A", "critical", 1), ("t", "a", "supporting", 2), ("t", "b", "critical", 3)], "test string, key string, priority string, at long")
    got = answers.judged(scores, given, "test", "key", "score", "priority", "at").first().answer_correctness
    assert got == round(3 / 13, 6)


# -- documents -----------------------------------------------------------------------------


def test_frontmatter_begins_on_the_first_line(spark):
    texts = {"---\na: 1\n---\n\n x": "x", "\n---\na: 1\n---\nx": "\n---\na: 1\n---\nx", "---\n---\nx": "x", " --- \nq\n --- ": "", "---\nnever closed": "---\nnever closed", "x\n---\ny\n---\nz": "x\n---\ny\n---\nz", "--- a\nb\n---\nc": "--- a\nb\n---\nc"}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", chunking.without_front(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == texts


def test_chunking_takes_linear_time(spark):
    """Four times the lines take not much more than four times the time; the header stands last."""
    took = []
    for n in (4_000, 16_000):
        df = spark.createDataFrame([(1, "\n".join(["some words here"] * n) + "\n## End\nx")], "d long, t string")
        assert chunking.chunks(df, "d", "t").count() == 2
        began = time.perf_counter()
        assert [r.token_count for r in chunking.chunks(df, "d", "t").orderBy("position").collect()] == [3 * n, 3]
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1


def test_chunks_are_counted_as_they_are_cut(spark):
    texts = ["", "a", "## a", "x\n## a\n### b\n##c\n## \n", "---\nq: 1\n---\n## a\n## b", "##  \nx", "## a\n" * 5, None]
    df = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    for level in (2, 3, 4):
        cut = {r.d: r.n for r in chunking.chunks(df, "d", "t", level).groupBy("d").agg(F.count("*").alias("n")).collect()}
        own = {r.d: r.n for r in df.select("d", chunking.chunk_count(F.col("t"), level).alias("n")).collect()}
        assert all(own[k] == cut[k] for k, t in enumerate(texts) if t is not None) and own[len(texts) - 1] is None


def test_index_counts(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "b c"), (4, None)], "d long, t string")
    i = bm25.index(df, "d", "t")
    assert {r.term: r.df for r in i.terms.collect()} == {"a": 1, "b": 2, "c": 1}
    total = i.totals.first()
    assert total.docs == 4 and total.mean_size > 0
    empty = bm25.index(df.limit(0), "d", "t")
    assert empty.totals.first().docs == 0 and empty.terms.collect() == []


def test_scratch_folder_without_a_setting(spark):
    """Neither sets a setting of the session nor needs one on a local master."""

    class Bare:
        """The session without the setting."""

        sparkContext, _jvm, _jsc = spark.sparkContext, spark._jvm, spark._jsc

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    a, b = scratch.folder(Bare), scratch.folder(Bare)
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


# -- measures ------------------------------------------------------------------------------


def test_measures_of_hits_are_those_of_truths(spark):
    rng = random.Random(9)
    rows = [(q, rng.choice([None, None, *range(1, 16)])) for q in range(20) for _ in range(6)]
    rows += [(99, None)]
    df = spark.createDataFrame(rows, "query_id long, rank long")
    totals = df.groupBy("query_id").agg(F.count("*").alias("truths"))
    assert sorted(metrics.ranking_measures(df).collect()) == sorted(metrics.measures_of_hits(df.where("rank is not null"), totals).collect())


def test_summaries_of_few_results(spark):
    names = ["score", "seconds", "cost", "cache_savings", "multi_hop", "judge", "embedding", "batch_savings", "total_cost", "quote_recall", "quote_precision", "quote_faithfulness", "explanation_faithfulness", "answer_correctness"]
    df = spark.createDataFrame([("m", 1, *[2.0] * 9, None, *[1.0] * 4), ("m", 2, *[4.0] * 9, 0.5, *[0.0] * 4)], f"model string, test long, {', '.join(f'{x} double' for x in names)}")
    got = {(r.model, r.test): r for r in evaluation.summaries(df, ["model", "test"]).collect()}
    assert set(got) == {("m", None), (None, 1), (None, 2)}
    both = got["m", None]
    assert (both.avg_score, both.std_dev_score, both.avg_quote_recall, both.std_dev_quote_recall, both.avg_cache_savings_pct, both.avg_infrastructure) == (3.0, 1.0, 0.5, 0.0, 50.0, 9.0)
    assert got[None, 1].avg_quote_recall is None and got[None, 1].std_dev_score == 0.0


# -- names and pieces ------------------------------------------------------------------------


def test_team_names(spark):
    one = lambda x: spark.range(1).select(x.alias("x")).first().x
    words = {"BABIES": "BABY", "babies": "baby", "ies": "ie", "boxes": "box", "churches": "church", "Marines": "Marine", "glasses": "glass", "s": "s", "as": "a", "Big  Brothers ": "Big Brother", "": "", "ox": "ox"}
    assert {k: one(hierarchy.singular(F.lit(k))) for k in words} == words
    assert one(hierarchy.readable_key(F.lit("void_dancer-o'neil x1b"))) == "Void Dancer O'Neil X1B"
    titles = {("VOID-DANCER TROUPE - LEAD", "void_dancer_troupes"): "LEAD", ("A - B - C", "a - b"): "C", ("A - B", "c"): "A - B", ("A-B", "a"): "A-B", ("RATLING - SNIPER", "ratlings"): "SNIPER"}
    assert {k: one(hierarchy.without_team(F.lit(k[0]), F.lit(k[1]))) for k in titles} == titles


def test_pieces_hold_all_text(spark):
    rng = random.Random(3)
    texts = ["", "a", "x" * 1024, "x" * 1025, "y. " * 900, ("z" * 2000 + ". ") * 3, ". a", *("".join(rng.choice(["word ", "end. ", "What?! ", "\n", "w" * 300]) for _ in range(rng.randrange(200))) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("i", messages.field_pieces(F.col("t")).alias("f"), messages.quote_pieces(F.col("t")).alias("q")).collect():
        bare = lambda x: "".join(x.split())
        assert max(map(len, [*r.f, *r.q, ""])) <= 1024
        assert bare("".join(r.f)) == bare(texts[r.i]) and bare("".join(r.q)) == bare(texts[r.i])


# -- streams -------------------------------------------------------------------------------

FRONT = "---\nsource: s\nlast_update_date: 2024-01-01\ndocument_type: faq\n---\n"


def test_ingestion(spark, tmp_path):
    def listing(name, files):
        spark.createDataFrame(list(files.items()), "path string, text string").write.parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    def notices(*rows):
        return spark.createDataFrame(list(rows), "run long, listing string")

    own = ingestion.Ingestion(spark, f"{tmp_path}/records", "tree")
    assert own.states().collect() == []
    first = listing("one", {"a": FRONT + "x\n## h\ny", "b": FRONT + "b", "c": "no front", "d": None})
    second = listing("two", {"a": FRONT + "x", "c": FRONT + "c", "b": "broken"})
    own.apply(notices((1, first)), 0)
    own.apply(notices((2, second)), 1)
    states = lambda: {(r.run, r.path): (r.state, r.chunks) for r in own.states().collect()}
    want = {(1, "a"): ("new", 2), (1, "b"): ("new", 1), (1, "c"): ("invalid", None), (1, "d"): ("invalid", None), (2, "a"): ("changed", 1), (2, "b"): ("invalid", 1), (2, "c"): ("new", 1)}
    assert states() == want
    ids = {(r.run, r.path): r.document_id for r in own.states().collect()}
    assert ids[1, "a"] == ids[2, "a"] and ids[1, "b"] == ids[2, "b"]
    own.apply(notices((2, second)), 1)  # a batch that runs again changes nothing
    assert states() == want
    own.apply(notices((3, first), (4, second)), 2)
    assert {k[1]: v[0] for k, v in states().items() if k[0] == 4} == {"a": "changed", "b": "invalid", "c": "unchanged"}
    with pytest.raises(ValueError, match="tree"):
        ingestion.Ingestion(spark, f"{tmp_path}/records", "another").apply(notices((5, first)), 3)
    other = ingestion.Ingestion(spark, f"{tmp_path}/records", "tree", settings="2")
    other.apply(notices((5, second)), 3)
    assert {r.path: r.state for r in other.record(3).collect()} == {"a": "new", "b": "invalid", "c": "new"}
    valid, invalid = ingestion.split(spark.read.parquet(first), "text")
    assert [r.path for r in valid.orderBy("path").collect()] == ["a", "b"] and {r.path: r.faults[0] for r in invalid.collect()} == {"c": "frontmatter", "d": "frontmatter"}


def test_memory_is_the_same_in_any_order():
    """The processor's fold, frame by frame, against all rows at once."""
    rng = random.Random(5)
    for _ in range(200):
        rows = [(rng.randrange(40), k, str(k)) for k in range(rng.randrange(1, 40))]
        ordered = sorted(rows)
        start = max((k for k in range(1, len(ordered)) if ordered[k][0] - ordered[k - 1][0] > 3), default=0)
        rng.shuffle(rows)
        held = []
        for k in range(0, len(rows), 4):
            held = sorted([*held, *rows[k : k + 4]])[-5:]
        assert timers.latest(held, 5, 3) == ordered[start:][-5:]


# -- hops ----------------------------------------------------------------------------------


def test_hops_over_both_lists(spark):
    chunks = spark.createDataFrame([(1, "Alpha", "alpha text", "", [1.0, 0.0]), (2, "Beta rules", "beta text", "sum", [0.0, 1.0]), (3, "Gamma", "gamma beta", None, [0.6, 0.8])], "id long, header string, text string, summary string, vector array<double>")
    over = retrieval.corpus(chunks, "id", "header", "text", "summary", "vector")
    embed = lambda q: q.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))

    def judge(queries, contexts):
        said = {"asks": '{"can_answer": false, "reasoning": "r", "missing_query": "beta rule, gamma thing"}', "knows": '{"can_answer": true, "reasoning": "r"}', "fails": "no json", "lacks": '{"can_answer": false}', "silent": '{"can_answer": false, "reasoning": "r", "missing_query": null}'}
        return [said[q.split()[0]] for q in queries]

    queries = spark.createDataFrame([(k, f"{x} alpha") for k, x in enumerate(["asks", "knows", "fails", "lacks", "silent"])], "query_id long, text string")
    got = retrieval.hybrid_hops(queries, over, embed, judge, k=1, hop_k=1, max_hops=2, least=0.5).collect()
    hops = {q: sorted((r.hop, r.id) for r in got if r.query_id == q) for q in range(5)}
    assert all(hops[q] == [(0, 1)] for q in (1, 2, 3, 4))
    assert (1, 2) in hops[0] and (0, 1) in hops[0]
    assert next(r.score for r in got if (r.query_id, r.id) == (0, 2)) == round(2 * 9 / 19 - 0.01, 6)
