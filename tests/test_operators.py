import io
import json
import math
import random
import re
import zipfile
from collections import Counter

import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream import api, config, schemas
from quillstream.operators import audit, calibrate, check, corpus, generation, pairs, ranks, scorers, segments, structure
from quillstream.plans import catalog
from quillstream.sources import fetch, readers, thresholds, writers
from quillstream.streaming import ingest


def test_sum_of_sections_is_total_and_rollup_matches_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for d in range(30):
        levels = [rng.randint(1, 4) for _ in range(rng.randint(1, 8))]
        own = [rng.randint(0, 3) for _ in levels]
        i = 0
        for level, n in zip(levels, own):
            rows.append((str(d), i, f"Heading {level}", "head"))
            rows.append((str(d), i + 1, "Normal", "word " * n))
            i += 2
        for k, level in enumerate(levels):
            total = own[k]
            for level2, n in zip(levels[k + 1 :], own[k + 1 :]):
                if level2 <= level:
                    break
                total += n
            if total:
                want[str(d), k + 1] = total
    blocks = spark.createDataFrame(rows, "doc_id string, block_idx int, style string, text string")
    got = {(r["doc_id"], r["section_idx"]): r["words"] for r in structure.rolled_up(structure.own_words(structure.walk(blocks))).collect()}
    assert got == want


@pytest.mark.parametrize("n", [1, 6, 7, 8, 9, 10, 11, 23])
def test_windows(spark, n):
    sents = spark.createDataFrame([(1, i, n, 0, f"s{i}") for i in range(n)], "doc_id int, sent_idx int, n_sents long, para_idx int, sentence string")
    want, start = [], 0
    while True:
        want.append((start, min(start + 7, n)))
        if want[-1][1] == n:
            break
        start += 3
    got = [(r["start"], r["end"]) for r in segments.windows(sents).orderBy("win_idx").collect()]
    assert got == want


def brute_threshold(rows):
    scores = sorted({s for _, s in rows})
    candidates = [scores[0] - 0.01, *[(a + b) / 2 for a, b in zip(scores, scores[1:])], scores[-1] + 0.01]
    def key(c):
        right = sum((s < c) == (k == "ai") for k, s in rows)
        return right, min(abs(s - c) for _, s in rows), -c
    return max(candidates, key=key)


def test_pick_threshold_matches_brute_force(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(40):
        own = [(rng.choice(["human", "ai"]), rng.randint(0, 12) / 8) for _ in range(rng.randint(2, 12))]
        if len({k for k, _ in own}) == 2:
            want[g] = brute_threshold(own)
        rows += [(g, k, s) for k, s in own]
    df = spark.createDataFrame(rows, "g int, cls string, score double")
    got = {r["g"]: r["threshold"] for r in calibrate.pick_threshold(df, ["g"]).collect()}
    assert got == want


def test_hold_out_of_separable_classes_is_perfect(spark):
    rows = [(f"h{i:02}a", "human", 0.9 + i / 100) for i in range(5)] + [(f"a{i:02}a", "ai", 0.5 + i / 100) for i in range(5)]
    df = spark.createDataFrame(rows, "sample_id string, cls string, score double")
    row = calibrate.leave_one_group_out(df).first()
    assert (row["correct"], row["predicted"], row["n_groups"]) == (10, 10, 5)
    rec = calibrate.record(df, ("u", "b"), "counts").first()
    assert rec["accuracy"] == 1.0 and rec["n_essays"] == 5 and rec["accuracy_kind"] == "leave-one-essay-out"


def test_empty_calibration_gives_no_threshold(spark):
    df = spark.createDataFrame([], "sample_id string, cls string, score double")
    assert calibrate.pick_threshold(df).count() == 0
    assert calibrate.band(df).first()["amber"] == 0.5
    assert calibrate.leave_one_group_out(df).first()["accuracy"] is None


def test_percentile_is_nearest_rank_from_below(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    assert df.agg(calibrate.percentile(F.col("x"), 0.9).alias("p")).first()["p"] == 9.0


def test_worst_opinion(spark):
    sents = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 0)], "doc_id int, sent_idx int, para_idx int, severity int")
    paras = spark.createDataFrame([(1, 1, 2)], "doc_id int, para_idx int, severity int")
    assert {r["sent_idx"]: r["severity"] for r in check.union(sents, paras).collect()} == {0: 1, 1: 2}


def docx(paragraphs):
    names = {"h1": "heading 1", "h2": "heading 2", "n": "Normal", "t": "Title"}
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"{" w:default=\"1\"" if k == "n" else ""}><w:name w:val="{v}"/></w:style>' for k, v in names.items())
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s != "n" else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}{table}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {ns}>{styles}</w:styles>")
    return out.getvalue()


def test_count_and_extract_docx(spark, tmp_path, capsys):
    path = tmp_path / "draft.docx"
    path.write_bytes(docx([("t", "My essay"), ("n", "Cover"), ("h1", "Intro"), ("n", "One two three."), ("h2", "Deep"), ("n", "Four (Lee, 2001)."), ("h1", "References"), ("n", "gone")]))
    report = api.count(readers.read_docx(spark, str(path)), 3).first()
    assert report["total"] == 5 and report["over"] == 2
    assert [(s["title"], s["words"], s["level"]) for s in report["sections"]] == [("My essay", 1, 1), ("Intro", 4, 1), ("Deep", 1, 2)]
    assert api.extract(readers.read_docx(spark, str(path))).first()["text"] == "Cover\n\nOne two three.\n\nFour (Lee, 2001)."
    assert api.main(["count", "x.txt"]) == 1
    assert api.main(["nothing"]) == 2
    assert api.main(["count", str(path), "--json"]) == 0
    assert '"total":5' in capsys.readouterr().out


def test_text_folder_and_calibrate(spark, tmp_path):
    for cls, words in (("human", "the cat sat on a mat by the door while rain fell"), ("ai", "the cat the cat the cat the cat the cat the cat")):
        (tmp_path / cls).mkdir()
        for i in range(3):
            (tmp_path / cls / f"{cls[0]}{i:02}a.txt").write_text(words + f" {i}\n")
        (tmp_path / cls / "blank.txt").write_text(" \n")
    human, ai = (readers.read_folder(spark, str(tmp_path / c)) for c in ("human", "ai"))
    assert human.count() == 3
    row = api.calibrate(human, ai, scorers.PairScorer(human.unionByName(ai))).first()
    assert row["n_human"] == 3 and row["n_ai"] == 3 and row["accuracy_in_sample"] >= 0.5


def test_check_with_function_scorers(spark):
    docs = spark.createDataFrame([(1, "Good one. Bad thing here. " + "word " * 30 + ".")], "doc_id int, text string")
    scorer = scorers.FunctionScorer(lambda: lambda texts: [0.9 if "Bad" in t else 0.1 for t in texts])
    rows = api.check(docs, scorer, scorer, 0.5, 0.6).collect()
    assert rows and all(r["severity"] == 2 for r in rows)


def test_pooled_mean_ignores_padding(spark):
    t = spark.createDataFrame([("a", [[1.0, 3.0], [3.0, 5.0], [9.0, 9.0]], [1, 1, 0])], "id string, hidden array<array<double>>, mask array<int>")
    assert scorers.pooled(t).first()["embedding"] == [2.0, 4.0]


def test_manifest_round_trip(spark, tmp_path):
    schema = "id string, vendor string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    told = lambda: [tuple(r.values()) for r in json.loads(open(path).read())]
    path = str(tmp_path / "m" / "manifest.json")
    writers.write_manifest(rows(("b", "old"), ("a", "x")), path)
    assert told() == [("b", "old"), ("a", "x")]
    for _ in range(2):
        writers.write_manifest(rows(("c", "y"), ("b", "new")), path, append=True)
    assert told() == [("a", "x"), ("b", "new"), ("c", "y")]
    assert [tuple(r) for r in readers.read_json(spark, path, schema).orderBy("id").collect()] == told()


def test_samples_are_files_with_a_trailing_newline(spark, tmp_path):
    n = writers.write_texts(spark.createDataFrame([("a01", "one"), ("a02", "two\n\nthree é")], "id string, text string"), str(tmp_path))
    assert n == 2 and (tmp_path / "a02.txt").read_text(encoding="utf-8") == "two\n\nthree é\n"
    assert sorted((r["sample_id"], r["text"]) for r in readers.read_folder(spark, str(tmp_path)).collect()) == [("a01", "one"), ("a02", "two\n\nthree é")]
    assert readers.essays_in(readers.read_folder(spark, str(tmp_path))).first()["n_essays"] == 2
    writers.write_rows(spark.createDataFrame([("a", "x")], "doc_id string, text string"), str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 1


def test_human_manifest(spark):
    picked = spark.createDataFrame([("e1", 0, "introduction", 3, "One two.")], "essay string, slot int, position string, para_idx int, text string")
    sources = spark.createDataFrame([("e1", "History", "t", "u", "d", "scan")], "essay string, subject string, topic string, source_url string, date_evidence string, extraction string")
    row = corpus.human_manifest(picked, sources, "h").first()
    assert row["id"] == "h01a" and row["words"] == 2 and len(row["sha256"]) == 64


def test_retry_machine():
    calls, slept = [], []

    def send(model, text):
        calls.append(model)
        if model == "a/gone":
            raise generation.Failure(404)
        if model == "b/busy":
            raise generation.Failure(429)
        return "bad" if len([c for c in calls if c == model]) < 3 else "good"

    pool = generation.Pool(["a/gone", "b/busy", "c/slips"])
    got = generation.generate_one("a/gone", "p", pool, send, lambda x: x if x == "good" else None, slept.append)
    assert got == ("good", "c/slips") and "a/gone" in pool.gone and not slept
    with pytest.raises(generation.Failure):
        generation.generate_one("c/slips", "p", pool, lambda m, t: (_ for _ in ()).throw(generation.Failure(401, "bad key")), str, slept.append)


def test_seeded_pool_spreads_vendors():
    pool = ["a/1", "a/2", "a/3", "b/1", "c/1"]
    got = generation.seeded_pool(pool, 7, 3)
    assert got == generation.seeded_pool(pool, 7, 3) and len({generation.vendor(m) for m in got[:3]}) == 3 and len(got) == 7


def test_generate_keeps_topic_order_and_fills_the_manifest():
    topics = [{"id": f"h0{i}b", "topic": "t {words}", "position": "analysis" if i else None, "subject": "s"} for i in range(5)]
    got = generation.generate(topics, ["a/1", "b/1"], 1, 110, lambda m, t: t, lambda x: x, lambda s: None, workers=3, prefix="k", finish=lambda t: t[:20])
    assert [g["id"] for g in got] == [f"k0{i}b" for i in range(5)] and [g["matches"] for g in got] == [t["id"] for t in topics]
    assert got[1]["prompt_template"] == generation.PLACED_PROMPT and got[0]["words_kept"] == len(got[0]["text"].split()) and got[0]["seed"] == 1
    assert list(got[0]) == [c.split()[0] for c in schemas.AI_MANIFEST.split(", ")] + ["text"]
    assert [generation.sample_id("a", x) for x in ("h07a", "no digits", "9", "x3!")] == ["a07a", "ano digits", "a9", "a3"]
    assert generation.catalog_models('{"data": [{"id": "a/1"}, {"x": 1}]}') == ["a/1"]
    assert generation.request("a/1", "p")["messages"] == [{"role": "user", "content": "p"}]


def test_a_model_gets_four_bad_answers():
    calls = []
    pool = generation.Pool(["a/bad", "b/good"])
    got = generation.generate_one("a/bad", "p", pool, lambda m, t: calls.append(m) or m, lambda x: x if x == "b/good" else None, lambda s: None)
    assert got == ("b/good", "b/good") and calls == ["a/bad"] * 4 + ["b/good"]
    with pytest.raises(generation.Failure):
        generation.generate_one("a/bad", "p", pool, lambda m, t: (_ for _ in ()).throw(generation.Failure(403, "Account")), str, lambda s: None)


def test_hold_out_matches_brute_force(spark):
    """Ties between groups, scores of one group only at both ends and in runs, groups that hold a whole class."""
    rng = random.Random(9)
    for trial in range(6):
        n_groups, values = [(2, 3), (3, 30), (5, 6), (8, 12), (12, 200), (4, 4)][trial]
        rows = [(f"g{g}", rng.choice(["human", "ai"]), rng.randint(0, values) / 8 + (g / 64 if trial % 2 else 0)) for g in range(n_groups) for _ in range(rng.randint(1, 9))]
        rows += [("g0", "human", 99.0), ("g1", "ai", -7.0)]
        want = {}
        for g in {r[0] for r in rows}:
            rest = [(k, s) for x, k, s in rows if x != g]
            if len({k for k, _ in rest}) == 2:
                want[g] = brute_threshold(rest)
        df = spark.createDataFrame(rows, "grp string, cls string, score double")
        assert {r["fold"]: r["threshold"] for r in calibrate.hold_out_thresholds(df).collect()} == want, trial
        held = calibrate.leave_one_group_out(df.withColumnRenamed("grp", "sample_id")).first()
        judged = [((s < want[g]) == (k == "ai")) for g, k, s in rows if g in want]
        assert (held["correct"], held["predicted"]) == (sum(judged), len(judged))


def test_running_sums_and_ranks_by_range(spark):
    rng = random.Random(3)
    values = [rng.randint(0, 3000) / 16 for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    counts = df.groupBy("x").count()
    got = sorted((r["x"], r["idx"], r["count_upto"], r["before"], r["after"]) for r in ranks.running(counts, "x", ["count"]).collect())
    distinct = sorted(set(values))
    upto = [sum(v <= d for v in values) for d in distinct]
    assert got == [(d, i, upto[i], distinct[i - 1] if i else None, distinct[i + 1] if i + 1 < len(distinct) else None) for i, d in enumerate(distinct)]
    for share in (0.0, 0.1, 0.9, 1.0):
        assert ranks.nearest_rank(df, "x", share).first()["value"] == sorted(values)[int(share * (len(values) - 1))]
    assert ranks.upper_middle(df, "x").first()["value"] == sorted(values)[len(values) // 2]
    assert ranks.nearest_rank(df.where("false"), "x", 0.9).first()["value"] is None


def test_windows_of_texts_and_of_tables_agree(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "\n".join(" ".join(f"Said {k} w." for k in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6)))) for i in range(40)], "doc_id int, text string")
    sents = segments.sentences_of(docs, "\n", 0)
    table = segments.document_sentences(segments.paragraphs(docs, "\n", 0))
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert rows(sents) == rows(table) and rows(segments.windows_of(docs, "\n", 0)) == rows(segments.windows(table)) and rows(sents)


def test_scored_sentences_with_all_and_with_some_windows(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"Said {k} words." for k in range(rng.randint(0, 40)))) for i in range(25)], "doc_id int, text string")
    for keep in ("true", "win_idx % 3 != 1", "false"):
        score = lambda wins: wins.where(keep).select("doc_id", "win_idx", (F.pmod(F.xxhash64("chunk"), F.lit(100)) / 100.0).alias("score"))  # noqa: B023, E731
        got = segments.scored_sentences(docs, score, "\n", 0)
        want = segments.sentence_scores(segments.sentences_of(docs, "\n", 0), score(segments.windows_of(docs, "\n", 0)))
        rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
        assert rows(got) == rows(want) and rows(got)


def test_plans_of_segments_move_texts_once(spark):
    docs = spark.createDataFrame([(1, "One. Two.")], "doc_id int, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(segments.sentences_of(docs, "\n", 0)) + plan(segments.windows_of(docs, "\n", 0))
    assert "CartesianProduct" not in plan(calibrate.leave_one_group_out(spark.createDataFrame([("a1", "ai", 0.5)], "sample_id string, cls string, score double")))


def test_threshold_files(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    assert thresholds.pair("none") == (0.9, None, False) and thresholds.pair("gemma-mlx") == (0.784, 0.8391, True)
    assert thresholds.band() == (0.5, 0.5, True) and thresholds.band("else") == (0.5, 0.35, False)
    thresholds.save("gemma-mlx", {"threshold": 0.7})
    assert thresholds.pair("gemma-mlx") == (0.7, None, True) and thresholds.pair("gemma-mlx", 0.6) == (0.6, None, True)
    thresholds.save("band-x", {"amber": 0.2})
    assert thresholds.band("x") == (0.5, 0.2, True) and thresholds.band_note(0.5, 0.2, True) is None
    assert "empty" in thresholds.band_note(0.5, 0.5, True) and "0.35" in thresholds.band_note(0.5, 0.35, False)
    config.remember_models_dir(str(tmp_path / "m"))
    assert config.models_dir() == str((tmp_path / "m").resolve())
    monkeypatch.setenv(config.VARIABLE, "/elsewhere")
    assert config.models_dir() == "/elsewhere"


def test_html_blocks():
    page = "<html><head><title>no</title><script>var a='<p>'</script><body><!-- no --><h1>A &amp; B &eacute;</h1><div>in a <b>div</b><br>line<td>cell<h3>C</h3><li>x<li>y"
    assert readers.html_blocks(page) == [("Heading 1", "A & B é"), ("Normal", "in a div line"), ("Normal", "cell"), ("Heading 3", "C"), ("Normal", "x"), ("Normal", "y")]
    assert readers.html_blocks(None) == readers.html_blocks("") == []


def test_page_headings_with_references_that_the_sql_leaves(spark, tmp_path):
    """Headings cut within a reference, other references and other levels; found over sf0.1."""
    pages = ["<h1>A &amp;&amp; b&amp</h1><p>x", "<h1>c &quot;d&lt;</h1><h2>no</h2>", "<h1 class='t'>e&am</h1>", "<h1>f &amp;amp; <b>g</b>&</h1>"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p.replace(chr(39), chr(34))}')" for i, p in enumerate(pages)) + ") t(page_id, html)")
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    assert oracle.compare(spark, con, catalog.page_headings, catalog.ORACLE_SQL["page_headings"], str(tmp_path)) is None
    assert readers.html_blocks("<p>&eacute;&amp;&lt", ()) == [("Normal", "&eacute;&amp;&lt")]


def test_blocks_of_pages_leave_in_small_batches():
    page = "<h1>head</h1>" + "<p>" + "word " * 4000
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(300)]), pa.array([page] * 299 + [None])], names=["doc_id", "html"])
    got = list(readers._parsed([batch], None))
    assert len(got) >= 5 and max(b.nbytes for b in got) < 2 * readers._HELD
    assert [x for b in got for x in b.column("doc_id").to_pylist()] == [str(i) for i in range(299) for _ in range(2)]
    assert not list(readers._parsed([], None))


def ratios(corpus, texts):
    """The pair scorer's formula, by brute force."""
    pairs = lambda t: list(zip(t.lower().split(), t.lower().split()[1:]))
    all_ = [p for t in corpus for p in pairs(t)]
    n_wv, n_w, n_v = Counter(all_), Counter(w for w, _ in all_), Counter(v for _, v in all_)
    q = lambda v: (n_v[v] + 1) / (len(all_) + len(n_v) + 1)
    loss = lambda t: sum(-math.log((n_wv[p] + q(p[1])) / (n_w[p[0]] + 1)) for p in pairs(t)) / sum(-math.log(q(v)) for _, v in pairs(t))
    return {i: loss(t) for i, t in enumerate(texts) if pairs(t)}


@pytest.mark.parametrize("hot", [(1, 1), (3, 2), (1 << 17, 1 << 18)])
def test_pair_scorer_moves_word_pairs_once(spark, monkeypatch, hot):
    """Whatever words and pairs are broadcast; over the corpus itself and over other texts."""
    rng = random.Random(8)
    draw = lambda k, n: [" ".join(rng.choice("the of a b c d e F g\u00a0h".split(" ")) for _ in range(rng.randint(0, n))) for _ in range(k)]
    corpus, other = draw(60, 30), ["", "the", "new words the of", *draw(20, 30)]
    monkeypatch.setattr(scorers.PairScorer, "HOT_WORDS", hot[0])
    monkeypatch.setattr(scorers.PairScorer, "HOT_PAIRS", hot[1])
    monkeypatch.setattr(scorers.PairScorer, "SAMPLE", 1)
    mine = spark.createDataFrame(list(enumerate(corpus)), "id int, text string").repartition(3)
    scorer = scorers.PairScorer(mine)
    for texts, said in ((mine, corpus), (spark.createDataFrame(list(enumerate(other)), "id int, text string"), other)):
        scored = scorer.score(texts)
        assert {r["id"]: pytest.approx(r["score"], rel=1e-12) for r in scored.collect()} == ratios(corpus, said)
    plan = scorer.score(mine)._jdf.queryExecution().sparkPlan().toString()
    assert "Window [count" in plan and not re.search("SortMergeJoin \\[w#", plan)


def test_check_by_sums_is_check_by_texts(spark):
    """Overlapping windows and paragraphs ask for a word pair once; sentences of one word, empty texts, list items between."""
    rng = random.Random(3)
    words = "the of a b c d e f g Σ\u00a0ΑΣ h".split(" ")
    line = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ".", '."', "?"]) for _ in range(n))
    texts = ["", "Stop.", "One. Two.", None] + ["\n".join(rng.choice([line(rng.randint(1, 60)), "• item one", ""]) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    pair = scorers.PairScorer(docs)
    asked = []
    both = {}
    for kind, scorer in (("sums", pair), ("texts", scorers.PairScorer(docs))):
        df = api.check(docs, scorers.Flipped(pair), scorer, 0.65, 0.7, "\n", 0.45, 0.4)
        asked.append(df._jdf.queryExecution().analyzed().toString().count("posexplode"))
        both[kind] = {(r["doc_id"], r["sent_idx"]): (r["sentence"], pytest.approx(r["score"], abs=1e-9), r["own_severity"], r["para_severity"], r["severity"]) for r in df.collect()}
    assert both["sums"] == both["texts"] and {x[3] for x in both["sums"].values()} >= {None, 0}
    assert asked[0] < asked[1]


def test_check_by_sums_moves_texts_once_and_lists_of_pairs(spark, monkeypatch):
    """Many batches and buckets; the corpus is the texts themselves or others; pairs that the corpus does not have."""
    monkeypatch.setattr(pairs, "BATCH", 3000)
    rng = random.Random(5)
    words = [*"the of a b Σ\u00a0ΑΣ İx ß \U0001f600".split(" "), "w" * 300, *(f"n{i}" for i in range(200))]
    line = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ".", "?"]) for _ in range(n))
    texts = [None, "", "Stop.", "\n"] + ["\n".join(rng.choice([line(rng.randint(1, 60)), "• item one", ""]) for _ in range(rng.randint(1, 6))) for _ in range(50)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    other = spark.createDataFrame([(t,) for t in [None, "", *texts[20:], line(400)]], "text string")
    for corpus in (docs, other):
        pair = scorers.PairScorer(corpus)
        df = api.check(docs, scorers.Flipped(pair), pair, 0.65, 0.7, "\n", 0.45, 0.4)
        got = {(r["doc_id"], r["sent_idx"]): (r["score"], r["own_severity"], r["para_severity"]) for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        want = api.check(docs, scorers.Flipped(pair), scorers.PairScorer(corpus), 0.65, 0.7, "\n", 0.45, 0.4).collect()
        assert got == {(r["doc_id"], r["sent_idx"]): (pytest.approx(r["score"], abs=1e-9), r["own_severity"], r["para_severity"]) for r in want}
        assert not re.search("Window|SortMergeJoin|BroadcastExchange", plan) and plan.count("ReusedExchange") == 1


def test_lists_of_pairs_come_back_in_their_order():
    packed = pairs._packed([(np.array([1, 0, 300]), b"a" + b"b" * 300), np.array([2**40, 0, 7]), np.zeros(0, np.int64)])
    lengths, data, n, none = pairs._unpacked(packed)
    assert pairs._names([lengths], [data]).to_pylist() == ["a", "", "b" * 300]
    assert pairs._numbers(n).tolist() == [2**40, 0, 7] and not len(pairs._numbers(none))
    starts, n = np.array([0, 0, 7, 15]), np.array([0, 7, 8, 11])
    many, begin, end = pairs._windows(starts, n, 7, 3)
    assert many.tolist() == [0, 1, 2, 3] and begin.tolist() == [0, 7, 10, 15, 18, 21] and end.tolist() == [7, 14, 15, 22, 25, 26]


def test_outline_of_many_sections(spark):
    """A long flat outline, and levels beyond nine."""
    rows = [("a", i, f"Heading {1 + i % 2 * 11}" if i % 3 else "Heading 12", "head") for i in range(0, 3000)]
    blocks = spark.createDataFrame([(d, 2 * i, s, t) for d, i, s, t in rows] + [("a", 2 * i + 1, "Normal", "one two") for _, i, _, _ in rows], "doc_id string, block_idx int, style string, text string")
    levels = [int(s.split()[1]) for _, _, s, _ in rows]
    got = {r["section_idx"]: r["words"] for r in structure.rolled_up(structure.own_words(structure.walk(blocks))).collect()}
    for k in range(0, 3000, 97):
        end = next((j for j in range(k + 1, 3000) if levels[j] <= levels[k]), 3000)
        assert got[k + 1] == 2 * (end - k)
    report = structure.count_report(blocks).first()
    assert report["total"] == 6000 and len(report["sections"]) == 3000


def write_folder(folder, texts):
    folder.mkdir()
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text + "\n")
    return str(folder)


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    rng = random.Random(1)
    words = "river stone garden letter window morning paper music winter field".split()
    prose = lambda: " ".join(rng.choice(words).capitalize() + " " + " ".join(rng.choices(words, k=9)) + "." for _ in range(8))
    human = write_folder(tmp_path / "human", {f"h{i:02}a": prose() for i in range(4)})
    ai = write_folder(tmp_path / "ai", {f"a{i:02}a": ("The same words come again and again here. " * 8).strip() for i in range(4)})
    draft = tmp_path / "draft.txt"
    draft.write_text(prose() + "\n\n" + "The same words come again and again here. " * 8)
    run = lambda *argv: (api.main(list(argv)), capsys.readouterr().out)
    code, out = run("calibrate", "--human-dir", human, "--ai-dir", ai, "--check", str(draft))
    assert code == 0 and "paragraphs flagged" in out and thresholds.pair("counts")[2] and thresholds.band()[2]
    code, out = run("bino", str(draft), "--reference", human)
    assert code == 0 and "P  1" in out and "P  2" in out
    assert "ratio:" in run("bino", "--text", prose(), "--threshold", "0.5")[1]
    code, out = run("score", str(draft))
    assert code == 0 and "reminder" in out
    assert run("score", str(draft), "--segments")[0] == 0 and "AI score" in run("score", "--text", prose())[1]
    code, out = run("check", str(draft), "--scorer", "test_operators:everything_red", "--window-scorer", "test_operators:nothing_red")
    assert code == 0 and "AI-ish run" in out and "100% of prose" in out and "windows alone: 0% red | paragraphs: 2 red, 0 borderline" in out
    (tmp_path / "blank.txt").write_text("\n")
    assert run("check", str(tmp_path / "blank.txt"))[0] == 1
    assert run("score")[0] == 2 and run("generate", "--topics", "x", "--out-dir", "y", "--endpoint", "z", "--model", "m")[0] == 2
    pairs = tmp_path / "pairs.json"
    pairs.write_text(json.dumps([{"source": "s", "scan_idx": i, "ocr": prose(), "clean": prose(), "similarity": 0.9} for i in range(3)]))
    code, out = run("ocr-bias", "--pairs", str(pairs))
    assert code == 0 and json.loads(out)["n"] == 3 and "median_error" in out


def everything_red():
    return scorers.FunctionScorer(lambda: lambda texts: [0.1] * len(texts), -1)


def nothing_red():
    return scorers.FunctionScorer(lambda: lambda texts: [0.1] * len(texts), 1)


def test_extract_and_count_commands(spark, tmp_path, capsys):
    path = tmp_path / "draft.docx"
    path.write_bytes(docx([("h1", "Intro"), ("n", "One two three."), ("n", "Four.")]))
    assert api.main(["extract", str(path)]) == 0
    assert (tmp_path / "draft prose.txt").read_text() == "One two three.\n\nFour."
    assert api.main(["extract", str(path), str(tmp_path / "own.txt")]) == 0 and (tmp_path / "own.txt").exists()
    assert api.main(["count", str(path)]) == 0 and "Intro: 4  [" in capsys.readouterr().out


def test_generate_command_body(spark, tmp_path):
    topics = [{"id": "h01a", "topic": "tides"}, {"id": "h02b", "topic": "salt", "position": "analysis"}]
    answer = "Here is the paragraph:\n" + "The water rises and falls twice each day here. " * 12
    made = api.generate(spark, topics, ["v/one"], str(tmp_path / "ai"), lambda m, p: answer, words=80, seed=2, sleep=lambda s: None)
    assert [r["id"] for r in made] == ["a01a", "a02b"] and all(80 <= r["words_kept"] <= 90 for r in made)
    assert (tmp_path / "ai" / "a01a.txt").read_text().startswith("The water")
    api.generate(spark, topics[:1], ["v/two"], str(tmp_path / "ai"), lambda m, p: answer, words=80, append=True, sleep=lambda s: None)
    kept = json.loads((tmp_path / "ai" / "manifest.json").read_text())
    assert [(r["id"], r["generated_by"], r["matches"]) for r in kept] == [("a01a", "v/two", "h01a"), ("a02b", "v/one", "h02b")]
    human = spark.createDataFrame([("h01a",), ("h03c",)], "id string")
    ai = spark.createDataFrame([(r["id"], r["matches"]) for r in kept], "id string, matches string")
    assert sorted(map(tuple, generation.unmatched(human, ai).collect())) == [("a02b", "ai"), ("h03c", "human")]


def test_build_corpus_command(spark, tmp_path, capsys):
    scans = tmp_path / "scans"
    scans.mkdir()
    lines = []
    for page in range(6):
        y = 0.9
        lines.append("A Title Of An Essay\t0.1\t0.95\t0.5\t1")
        for k in range(7):
            said = ("Along the coast the " if k == 0 else "") + "water rises and falls twice a day while boats wait outside for it" + (" again." if k == 6 else "")
            lines.append(f"{said}\t0.1\t{y:.3f}\t{0.3 if k == 6 else 0.8}\t1")
            y -= 0.02
        lines.append("---PAGEBREAK---")
    (scans / "Marine_Studies_4.tsv").write_text("\n".join(lines) + "\n")
    assert api.main(["build-corpus", "--tsv-dir", str(scans), "--out-dir", str(tmp_path / "human")]) == 0
    rows = json.loads((tmp_path / "human" / "manifest.json").read_text())
    assert [r["id"] for r in rows] == ["h01a", "h01b", "h01c"] and {r["topic"] for r in rows} == {"A Title Of An Essay"} and {r["subject"] for r in rows} == {"Marine Studies"}
    assert len(list((tmp_path / "human").glob("*.txt"))) == 3 and "3 samples from 1 essays" in capsys.readouterr().out
    clean = write_folder(tmp_path / "clean", {"c1": 'He said "so" 4 times'})
    assert api.main(["build-corpus", "--tsv-dir", str(scans), "--out-dir", str(tmp_path / "x"), "--known-clean", clean]) == 1


def test_demo_and_download_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    monkeypatch.setenv("HF_HOME", "")
    draft = str(tmp_path / "demo.docx")
    assert api.main(["demo", draft]) == 0 and api.main(["count", draft]) == 0
    out = capsys.readouterr().out
    assert "Introduction: 24" in out and "Limits" in out and "Bibliography" not in out
    assert [tuple(r)[2:] for r in readers.read_docx(spark, draft).orderBy("block_idx").collect()] == api.DEMO
    got = fetch.models(str(tmp_path / "m"), "small", ["own/model"], lambda r: r + "!")
    assert got == ["own/model!", *(r + "!" for r in scorers.MODEL_PAIRS["small"])] and config.models_dir() == str((tmp_path / "m").resolve())
    assert api.main(["download", "--pair", "nothing"]) == 1


def test_exemplars_are_fetched_whole_or_not_at_all(tmp_path):
    calls, path = [], str(tmp_path / "x" / "a.pdf")

    def get(url):
        calls.append(url)
        if len(calls) == 1:
            raise OSError("cut")
        return b"%PDF" + b"x" * (10 if len(calls) == 2 else 200_000)

    assert fetch.exemplar("u", path, get) and len(calls) == 3
    assert fetch.exemplar("u", path, get) and len(calls) == 3
    assert not fetch.exemplar("u", str(tmp_path / "b.pdf"), lambda u: b"<html>" * 50_000) and not (tmp_path / "b.pdf").exists()


def test_pdf_text_layer(spark, tmp_path):
    tool = tmp_path / "pdftotext"
    tool.write_text("#!/bin/sh\ncat\n")
    tool.chmod(0o755)
    (tmp_path / "one.pdf").write_bytes(b"First  line\nof it.\n \nSecond.\n")
    rows = [tuple(r) for r in readers.read_pdf(spark, str(tmp_path / "one.pdf"), tool=str(tool)).orderBy("para_idx").collect()]
    assert rows == [("one", 0, "First line of it."), ("one", 1, "Second.")]
    with pytest.raises(Exception, match="needs no-such-tool"):
        readers.read_pdf(spark, str(tmp_path / "one.pdf"), tool="no-such-tool").collect()


def test_pooled_head(spark):
    import numpy as np

    encode = lambda: lambda texts: (np.array([[[len(t), 1.0], [9.0, 9.0]] for t in texts]), np.array([[1, 0]] * len(texts)))
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id int, text string")
    got = {r["id"]: r["score"] for r in scorers.PooledHead(encode, [1.0, -2.0]).score(df).collect()}
    assert got[1] == pytest.approx(0.5) and got[2] == pytest.approx(1 / (1 + np.exp(-2.0)))


def test_neural_scorers_say_what_they_need(spark):
    pytest.importorskip("pyspark")
    for scorer in (scorers.neural_pair("a", "b"), scorers.transformer("c")):
        try:
            import torch  # noqa: F401
        except ImportError:
            with pytest.raises(Exception, match="needs torch and transformers"):
                scorer.score(spark.createDataFrame([(1, "x")], "id int, text string")).collect()


def test_fuzzy_pairs_take_the_best_left(spark):
    scans = spark.createDataFrame([("s", 0, "a quiet harbour at n1ght"), ("s", 1, "a quiet harbour at night."), ("t", 0, "a quiet harbour at night")], "source string, scan_idx int, ocr string")
    clean = spark.createDataFrame([("s", 0, "a quiet harbour at night"), ("s", 1, "a quiet harbour at nights"), ("u", 0, "x")], "source string, clean_idx int, clean string")
    got = sorted((r["source"], r["scan_idx"], r["clean"]) for r in audit.pair_up(scans, clean).collect())
    used, want = set(), []
    for i, t in enumerate(["a quiet harbour at n1ght", "a quiet harbour at night."]):
        r, c = max((audit.ratio(x, t), x) for x in ["a quiet harbour at night", "a quiet harbour at nights"] if x not in used)
        used.add(c)
        want.append(("s", i, c))
    assert got == want


def test_stream_scores_what_arrives(spark, tmp_path):
    spark.createDataFrame([(1, "One. Two."), (2, "Three.")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = ingest.arriving(spark, str(tmp_path / "in"))
    q = ingest.score_stream(stream, lambda b: segments.document_sentences(segments.paragraphs(b, "\n", 0)), str(tmp_path / "out"), str(tmp_path / "check"), once=True)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
