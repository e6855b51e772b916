"""The commands as functions from tables to tables, and a small command line over files.

    python -m quillstream.api count draft.docx --limit 4000 --json
    python -m quillstream.api extract draft.docx [prose.txt]
    python -m quillstream.api score draft.txt [--segments] [--tag tech]     (or --text "...")
    python -m quillstream.api bino draft.txt [--threshold 0.9] [--tag tech] (or --text "...")
    python -m quillstream.api check draft.txt
    python -m quillstream.api calibrate --human-dir human --ai-dir ai [--check draft.txt]
    python -m quillstream.api generate --topics topics.json --out-dir ai --endpoint URL --model vendor/name
    python -m quillstream.api build-corpus --tsv-dir scans --out-dir human
    python -m quillstream.api ocr-bias --pairs pairs.json
    python -m quillstream.api demo draft.docx
    python -m quillstream.api download models --pair small

``--scorer module:name`` names a scorer, or a function without arguments that makes one. Without it the counted
stand-ins are used, over the texts of ``--reference`` or the draft itself; they have thresholds of their own only.
Scores are directional only; a flag is never evidence of who wrote a text.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import text as T
from .operators import audit, corpus, generation, structure
from .operators import calibrate as cal
from .operators import check as checking
from .operators import segments as seg
from .operators.scorers import Flipped, PairScorer, Scorer
from .sources import fetch, readers, thresholds, writers


def count(blocks: DataFrame, limit: int | None = None) -> DataFrame:
    return structure.count_report(blocks, limit)


def extract(blocks: DataFrame) -> DataFrame:
    return structure.prose(blocks)


def paragraph_flags(scores: DataFrame, direction: int, threshold: float, amber: float | None = None) -> DataFrame:
    """Adds flag: 'AI-ish', 'borderline' or null. High scores flag from 0.5 or ``threshold`` on, low ones below it."""
    score = F.col("score")
    if direction > 0:
        return scores.withColumn("flag", F.when(score >= threshold, "AI-ish"))
    return scores.withColumn("flag", F.when(score < threshold, "AI-ish").when(score < F.lit(amber).cast("double"), "borderline"))


def score_paragraphs(docs: DataFrame, scorer: Scorer, sep: str = "\n\n", threshold: float = seg.RED, amber: float | None = None) -> DataFrame:
    """(doc_id, para_idx, text, score, flag): prose paragraphs; short ones are not scored."""
    paras = seg.paragraphs(docs, sep)
    ids = F.struct("doc_id", "para_idx").alias("id")
    scores = scorer.score(paras.select(ids, "text")).select("id.doc_id", "id.para_idx", "score")
    return paragraph_flags(paras.join(scores, ["doc_id", "para_idx"], "left"), scorer.direction, threshold, amber)


def _by_window(scorer: Scorer):
    """From windows to (doc_id, win_idx, score)."""
    return lambda wins: scorer.score(wins.select(F.struct("doc_id", "win_idx").alias("id"), F.col("chunk").alias("text"))).select("id.doc_id", "id.win_idx", "score")


def window_scores(docs: DataFrame, scorer: Scorer, sep: str = "\n\n") -> DataFrame:
    """(doc_id, win_idx, score) of the overlapping windows over all prose, short paragraphs too."""
    return _by_window(scorer)(seg.windows_of(docs, sep, 0))


def score_segments(docs: DataFrame, scorer: Scorer, red: float = seg.RED, amber: float = seg.AMBER, sep: str = "\n\n") -> DataFrame:
    """(doc_id, sent_idx, n_sents, para_idx, sentence, score, severity): each sentence by the worst window over it."""
    return seg.scored_sentences(docs, _by_window(scorer), sep, 0).withColumn("severity", seg.severity(F.col("score"), red, amber))


def paragraph_verdicts(docs: DataFrame, scorer: Scorer, threshold: float, amber: float | None = None, sep: str = "\n\n") -> DataFrame:
    """(doc_id, para_idx, score, severity) of the paragraphs long enough for a scorer of which low is bad."""
    paras = seg.paragraphs(docs, sep, 0).where(T.word_count(F.col("text")) >= T.MIN_PROSE_WORDS)
    scores = scorer.score(paras.select(F.struct("doc_id", "para_idx").alias("id"), "text")).select("id.doc_id", "id.para_idx", "score")
    return scores.withColumn("severity", seg.low_severity(F.col("score"), F.lit(threshold), F.lit(amber)))


def check(docs: DataFrame, window_scorer: Scorer, pair_scorer: Scorer, threshold: float, amber: float | None = None, sep: str = "\n\n", red: float = seg.RED, window_amber: float = seg.AMBER) -> DataFrame:
    """Sentences with the worse of their windows' and their paragraph's verdicts.

    Two scorers that read the same sums over word pairs are asked once, by sentence.
    """
    base = getattr(pair_scorer, "base", None)
    if base is not None and getattr(window_scorer, "base", None) is base:
        told = seg.summed_sentences(docs, base.losses, window_scorer.of_sums, sep)
        score = F.when(F.col("words") >= T.MIN_PROSE_WORDS, pair_scorer.of_sums(F.col("a"), F.col("b")))
        para = F.when(score.isNotNull(), seg.low_severity(score, F.lit(threshold), F.lit(amber).cast("double")))
        sents = told.select("doc_id", "para_idx", "sent_idx", "n_sents", "sentence", "score", seg.severity(F.col("score"), red, window_amber).alias("own_severity"), para.alias("para_severity"))
        return sents.withColumn("severity", seg.worse(F.col("own_severity"), F.col("para_severity")))
    sents = score_segments(docs, window_scorer, red, window_amber, sep)
    return checking.union(sents, paragraph_verdicts(docs, pair_scorer, threshold, amber, sep))


def calibrate(human: DataFrame, ai: DataFrame, scorer: Scorer, pair: tuple[str, str] = ("unigram", "bigram"), backend: str = "counts") -> DataFrame:
    """The pair record of two sets of samples (sample_id, text). Scores are kept, as the record reads them many times."""
    both = human.withColumn("cls", F.lit("human")).unionByName(ai.withColumn("cls", F.lit("ai")))
    scores = scorer.score(both.select(F.struct("sample_id", "cls").alias("id"), "text"))
    return cal.record(scores.select("id.sample_id", "id.cls", "score").persist(), pair, backend)


def fit_band(human: DataFrame, scorer: Scorer, sep: str = "\n\n") -> DataFrame:
    """The band record of human samples (sample_id, text): all their windows, scored."""
    docs = human.withColumnRenamed("sample_id", "doc_id")
    return cal.band(window_scores(docs, scorer, sep).select(F.col("doc_id").alias("sample_id"), "score"))


def scanned_bodies(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Body paragraphs (essay, para_idx, text) of scanned runs, and the titles found (essay, title)."""
    page_lines = corpus.lines(runs)
    running = corpus.running_text(page_lines)
    return corpus.body_slice(corpus.paragraphs(page_lines, running)), corpus.titles(running)


def build_corpus(bodies: DataFrame, titles: DataFrame, sources: DataFrame, prefix: str = "h", per_essay: int = 3) -> DataFrame:
    """Manifest rows, with text, of essays' body paragraphs; ``sources`` as for ``corpus.human_manifest``.

    Essays that give fewer than ``per_essay`` samples are left out. A source without a topic takes its title, or else
    the subject.
    """
    picked = corpus.pick(bodies.withColumn("text", T.strip_markers(F.col("text"))), per_essay)
    enough = picked.groupBy("essay").count().where(F.col("count") >= per_essay)
    titled = sources.join(titles, "essay", "left").withColumn("topic", F.coalesce("topic", "title", "subject")).drop("title")
    return corpus.human_manifest(picked.join(enough, "essay", "left_semi"), titled, prefix)


def ocr_bias(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """What scanning does to scores: both versions of each pair (source, scan_idx, clean, ocr) through the scorer."""
    both = pairs.select(F.struct("source", "scan_idx").alias("pair"), F.explode(F.create_map(F.lit("clean"), "clean", F.lit("ocr"), "ocr")).alias("side", "text"))
    scores = scorer.score(both.select(F.struct("pair", "side").alias("id"), "text"))
    wide = scores.groupBy("id.pair").agg(*[F.max(F.when(F.col("id.side") == s, F.col("score"))).alias(s) for s in ("clean", "ocr")])
    return audit.bias_summary(wide)


def _scorer(name: str | None) -> Scorer | None:
    if not name:
        return None
    module, _, attribute = name.partition(":")
    made = getattr(importlib.import_module(module), attribute)
    return made() if isinstance(made, type) or not hasattr(made, "score") else made


def _draft(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """(doc_id, text) of a file, paragraphs parted by blank lines, or of --text."""
    if getattr(args, "text", None):
        return spark.createDataFrame([("text", args.text)], "doc_id string, text string")
    if args.path.lower().endswith(".docx"):
        return structure.prose(readers.read_docx(spark, args.path)).select("doc_id", "text")
    return readers.read_texts(spark, args.path)


def _stand_in(spark: SparkSession, args: argparse.Namespace, docs: DataFrame) -> PairScorer:
    return PairScorer(readers.read_texts(spark, f"{args.reference.rstrip('/')}/*.txt") if args.reference else docs)


def _report_paragraphs(scores: DataFrame, direction: int, threshold: float) -> None:
    share = F.col("score") if direction > 0 else T.aiish(F.col("score"), F.lit(threshold))
    for r in scores.select("para_idx", "score", T.bar(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).alias("bar"), "flag", F.regexp_replace(F.left("text", F.lit(70)), "\n", " ").alias("preview")).orderBy("para_idx").toLocalIterator():
        print(f"P{r['para_idx'] + 1:>3}  {r['score']:5.2f}  [{r['bar']}]{'  <-- ' + r['flag'] if r['flag'] else ''}\n      {r['preview']}...")
    for r in seg.summary(scores, F.coalesce(F.col("flag") == "AI-ish", F.lit(False))).collect():
        print("-" * 60 + f"\naverage score: {r['mean']:.2f}   |   {r['flagged']}/{r['n']} paragraphs flagged\nreminder: directional only.")


def _report_segments(sents: DataFrame) -> None:
    """Flagged runs first, each sentence cut to 90 characters, then the shares."""
    runs = seg.flagged_runs(sents)
    within = sents.alias("s").join(runs.alias("r"), F.expr("s.doc_id = r.doc_id and s.sent_idx >= r.start and s.sent_idx < r.end"))
    last, none = None, True
    for r in within.select("r.start", "r.end", F.col("r.severity").alias("worst"), F.col("r.score").alias("top"), seg.status(F.col("s.severity")).alias("status"), F.left("s.sentence", F.lit(90)).alias("said"), "s.sent_idx").orderBy("sent_idx").toLocalIterator():
        if r["start"] != last:
            print(f"\n-- {'AI-ish' if r['worst'] == seg.RED_ else 'borderline'} run, sentences {r['start'] + 1}-{r['end']}, worst {r['top']:.2f} --")
            last, none = r["start"], False
        print(f"  [{r['status']:>5}] {r['said']}")
    if none:
        print("no flagged segments")
    for r in seg.word_shares(sents).collect():
        print("-" * 60 + f"\n{r['red_share']:.0%} of prose in AI-flagged segments, plus {r['amber_share']:.0%} borderline")


#: A made-up draft of five sections, for trying the commands.
DEMO = [
    ("Normal", "A made-up report on bread and room temperature"),
    ("Heading 1", "Introduction"),
    ("Normal", "Dough rises faster in a warm kitchen than in a cold one (Tremaine, 2019). This report asks by how much, with one recipe and one oven."),
    ("Heading 1", "Method"),
    ("Normal", "Twelve loaves were made over two weeks. The room was measured each hour, and the height of the dough was read from a marked jar."),
    ("Heading 2", "Limits"),
    ("Normal", "Only one kind of flour was used, and the kitchen window stood open on two of the days, which may have cooled the jar."),
    ("Heading 1", "Results"),
    ("Normal", "Figure 1: height against temperature"),
    ("Normal", "At sixteen degrees the dough took four hours to double. At twenty-four degrees it took less than two, and the crumb was coarser."),
    ("Heading 1", "Conclusion"),
    ("Normal", "A warmer room made the dough rise faster in every pair of loaves, so a recipe should name a temperature beside a time."),
    ("Heading 1", "Bibliography"),
    ("Normal", "Tremaine, A. (2019). A made-up book on bread."),
]


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillstream")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *, draft: bool = False, scored: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        if draft:
            p.add_argument("path", nargs="?")
        if scored:
            p.add_argument("--scorer")
            p.add_argument("--reference")
            p.add_argument("--tag", default="")
            p.add_argument("--pair", default="counts")
        return p

    p = command("count")
    p.add_argument("path")
    p.add_argument("--limit", type=int)
    p.add_argument("--json", action="store_true")
    p = command("extract")
    p.add_argument("path")
    p.add_argument("out", nargs="?")
    p = command("score", draft=True, scored=True)
    p.add_argument("--text")
    p.add_argument("--segments", action="store_true")
    p = command("bino", draft=True, scored=True)
    p.add_argument("--text")
    p.add_argument("--threshold", type=float)
    p = command("check", scored=True)
    p.add_argument("path")
    p.add_argument("--window-scorer")
    p = command("calibrate", scored=True)
    p.add_argument("--human-dir", required=True)
    p.add_argument("--ai-dir", required=True)
    p.add_argument("--check")
    p.add_argument("--window-scorer")
    p = command("generate")
    p.add_argument("--topics", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--endpoint", required=True)
    p.add_argument("--prefix", default="a")
    p.add_argument("--model", action="append", required=True)
    p.add_argument("--seed", type=int)
    p.add_argument("--words", type=int, default=110)
    p.add_argument("--append", action="store_true")
    p.add_argument("--workers", type=int, default=1)
    p.add_argument("--timeout", type=int, default=180)
    p = command("build-corpus")
    p.add_argument("--tsv-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--prefix", default="h")
    p.add_argument("--per-essay", type=int, default=3)
    p.add_argument("--known-clean")
    p.add_argument("--extra")
    p.add_argument("--dry-run", action="store_true")
    p = command("ocr-bias", scored=True)
    p.add_argument("--pairs", required=True)
    p = command("demo")
    p.add_argument("path")
    p = command("download")
    p.add_argument("folder", nargs="?")
    p.add_argument("--pair")
    p.add_argument("--model", action="append", default=[])
    return parser


def _accept(spark: SparkSession):
    """An answer cleaned, or None if it is no prose or no sample."""

    def accept(answer: str) -> str | None:
        one = spark.createDataFrame([(answer,)], "t string").select(T.clean_response(F.col("t")).alias("t"))
        row = one.select("t", T.looks_like_prose(F.col("t")).alias("prose"), T.sample_problem(F.col("t")).alias("problem")).first()
        return row["t"] if row["t"] and row["prose"] and row["problem"] is None else None

    return accept


def generate(spark: SparkSession, topics: list[dict], models: list[str], out_dir: str, send, words: int = 110, seed: int | None = None, workers: int = 1, prefix: str = "a", append: bool = False, sleep=time.sleep) -> list[dict]:
    """Samples and manifest of an AI corpus in ``out_dir``; the manifest's rows of this run, in the topics' order."""
    trim = lambda text: spark.createDataFrame([(text,)], "t string").select(T.trim_to_words(F.col("t"), words)).first()[0]
    rows = generation.generate(topics, models, seed, words, send, _accept(spark), sleep, workers, prefix, trim)
    new = spark.createDataFrame([tuple(r[k] for k in rows[0]) for r in rows] if rows else [], schemas.AI_MANIFEST + ", text string")
    writers.write_texts(new.select("id", "text"), out_dir)
    writers.write_manifest_rows([{k: v for k, v in r.items() if k != "text"} for r in rows], os.path.join(out_dir, "manifest.json"), append)
    return rows


def main(argv: list[str]) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if args.command in ("count", "extract") and not args.path.lower().endswith(".docx"):
        print("only .docx files have an outline to count", file=sys.stderr)
        return 1
    if args.command in ("score", "bino") and not (args.path or args.text):
        print("give a file or --text", file=sys.stderr)
        return 2
    if args.command == "generate" and not os.environ.get("QUILLSTREAM_API_KEY"):
        print("set QUILLSTREAM_API_KEY to the endpoint's key", file=sys.stderr)
        return 2
    if args.command == "demo":
        writers.write_docx(DEMO, args.path)
        print(f"a made-up draft -> {args.path}")
        return 0
    if args.command == "download":
        try:
            print("\n".join(fetch.models(args.folder, args.pair, args.model)))
        except (RuntimeError, ValueError) as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    spark = SparkSession.builder.appName("quillstream").getOrCreate()
    return _COMMANDS[args.command](spark, args)


def _count(spark: SparkSession, args: argparse.Namespace) -> int:
    for row in count(readers.read_docx(spark, args.path), args.limit).toLocalIterator():
        if args.json:
            print(row["json"])
            continue
        for s in row["sections"]:
            share = s["words"] / row["total"] if row["total"] else 0.0
            print(f"{'  ' * (s['level'] - 1)}{s['title']}: {s['words']}  [{'#' * round(share * 20)}]")
        print(f"total: {row['total']}" + (f", over by {row['over']}" if (row["over"] or 0) > 0 else ""))
    return 0


def _extract(spark: SparkSession, args: argparse.Namespace) -> int:
    for row in extract(readers.read_docx(spark, args.path)).toLocalIterator():
        out = Path(args.out) if args.out else Path(args.path).with_name(Path(args.path).stem + " prose.txt")
        out.write_text(row["text"], encoding="utf-8")
        print(f"{row['words']} words -> {out}")
    return 0


def _windows(spark: SparkSession, args: argparse.Namespace, docs: DataFrame) -> Scorer:
    return _scorer(getattr(args, "window_scorer", None) or (args.scorer if args.command == "score" else None)) or Flipped(_stand_in(spark, args, docs))


def _score(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = _draft(spark, args)
    scorer = _windows(spark, args, docs)
    if args.segments:
        red, amber, fitted = thresholds.band(args.tag)
        print(thresholds.band_note(red, amber, fitted) or "", end="\n")
        _report_segments(score_segments(docs, scorer, red, amber))
    elif args.text:
        print(f"AI score: {scorer.score(docs.withColumnRenamed('doc_id', 'id')).first()['score']:.2f}")
    else:
        _report_paragraphs(score_paragraphs(docs, scorer), scorer.direction, seg.RED)
    return 0


def _bino(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = _draft(spark, args)
    scorer = _scorer(args.scorer) or _stand_in(spark, args, docs)
    threshold, amber, calibrated = thresholds.pair(cal.record_name(args.pair, tag=args.tag), args.threshold)
    if not calibrated:
        print(f"warning: {args.pair!r} was never calibrated, using placeholder {threshold}")
    if args.text:
        score = scorer.score(docs.withColumnRenamed("doc_id", "id")).first()["score"]
        print(f"ratio: {score:.2f}  ({'AI-ish' if score < threshold else 'human-ish'}, threshold {threshold})")
    else:
        _report_paragraphs(score_paragraphs(docs, scorer, threshold=threshold, amber=amber), -1, threshold)
    return 0


def _check(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = _draft(spark, args)
    if seg.paragraphs(docs, min_words=0).isEmpty():
        print("No prose found.")
        return 1
    windows, pair = _windows(spark, args, docs), _scorer(args.scorer) or _stand_in(spark, args, docs)
    red, amber, fitted = thresholds.band(args.tag)
    threshold, pair_amber, calibrated = thresholds.pair(cal.record_name(args.pair, tag=args.tag))
    for note in (thresholds.band_note(red, amber, fitted), None if calibrated else f"warning: {args.pair!r} was never calibrated, using placeholder {threshold}"):
        if note:
            print(note)
    sents = check(docs, windows, pair, threshold, pair_amber, red=red, window_amber=amber).cache()
    _report_segments(sents)
    for r in seg.word_shares(sents.withColumn("severity", F.col("own_severity"))).collect():
        counts = paragraph_verdicts(docs, pair, threshold, pair_amber).agg(F.count_if(F.col("severity") == seg.RED_).alias("red"), F.count_if(F.col("severity") == seg.AMBER_).alias("amber")).first()
        print(f"windows alone: {r['red_share']:.0%} red | paragraphs: {counts['red']} red, {counts['amber']} borderline")
    return 0


def _calibrate(spark: SparkSession, args: argparse.Namespace) -> int:
    human, ai = readers.read_folder(spark, args.human_dir), readers.read_folder(spark, args.ai_dir)
    if human.isEmpty() or ai.isEmpty():
        print("both folders need .txt files", file=sys.stderr)
        return 2
    scorer = _scorer(args.scorer) or PairScorer(human.unionByName(ai))
    both = human.withColumn("cls", F.lit("human")).unionByName(ai.withColumn("cls", F.lit("ai")))
    scores = scorer.score(both.select(F.struct("sample_id", "cls").alias("id"), "text")).select("id.sample_id", "id.cls", "score").cache()
    record = cal.record(scores, (args.pair, args.pair), "counts" if not args.scorer else args.scorer).toJSON().first()
    print(record)
    print(f"saved -> {thresholds.save(cal.record_name(args.pair, tag=args.tag), json.loads(record))}")
    windows = _scorer(args.window_scorer) or Flipped(scorer)
    band = json.loads(fit_band(human, windows).toJSON().first())
    print(f"saved -> {thresholds.save('-'.join(x for x in ('band', args.tag) if x), band)}")
    if args.check:
        # Not the rounded threshold of the record.
        exact = cal.pick_threshold(scores).first()["threshold"]
        args.path = args.check
        _report_paragraphs(score_paragraphs(_draft(spark, args), scorer, threshold=exact, amber=json.loads(record).get("amber")), -1, exact)
    return 0


def _generate(spark: SparkSession, args: argparse.Namespace) -> int:
    topics = json.loads(Path(args.topics).read_text(encoding="utf-8"))
    send = generation.http_transport(args.endpoint, os.environ["QUILLSTREAM_API_KEY"], args.timeout)
    rows = generate(spark, topics, args.model, args.out_dir, send, args.words, args.seed, args.workers, args.prefix, args.append)
    used = sorted({r["generated_by"] for r in rows})
    print(f"wrote {len(rows)} samples + manifest -> {args.out_dir}\nmodels used ({len(used)}): {', '.join(used)}")
    return 0


def _build_corpus(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.known_clean:
        changed = corpus.changed_by_strip(readers.read_folder(spark, args.known_clean)).collect()
        if changed:
            print("the rules change known-clean samples: " + ", ".join(r["sample_id"] for r in changed), file=sys.stderr)
            return 1
    bodies, titles = scanned_bodies(readers.read_tsv(spark, f"{args.tsv_dir.rstrip('/')}/*.tsv"))
    own = bodies.select("essay").distinct().select("essay", T.subject_of(F.col("essay")).alias("subject"), *[F.lit(None).cast("string").alias(c) for c in ("topic", "source_url", "date_evidence")], F.lit("scan").alias("extraction"))
    if args.extra:
        extra = readers.read_json(spark, args.extra, schemas.EXTRA_SOURCE)
        name = F.regexp_replace(F.regexp_replace("pdf", r"^.*/", ""), r"\.[^.]*$", "")
        told = extra.select(name.alias("essay"), "subject", "topic", "source_url", "date_evidence", F.col("route").alias("extraction"))
        own = own.join(told, "essay", "left_anti").unionByName(told)
        # A bare file name stands beside the folder of scans.
        beside = Path(args.tsv_dir.rstrip("/")).resolve().parent
        for row in extra.where("route = 'text'").select("pdf").collect():
            layer = readers.read_pdf(spark, row["pdf"] if os.path.isabs(row["pdf"]) else str(beside / row["pdf"]))
            bodies = bodies.unionByName(corpus.body_slice(layer.withColumnRenamed("doc_id", "essay")), allowMissingColumns=True)
    made = build_corpus(bodies, titles, own, args.prefix, args.per_essay).cache()
    if not args.dry_run:
        writers.write_texts(made.select("id", "text"), args.out_dir)
        writers.write_manifest_rows([r.asDict() for r in made.drop("text").orderBy("id").collect()], os.path.join(args.out_dir, "manifest.json"))
    print(f"{made.count()} samples from {made.select('source_essay').distinct().count()} essays -> {args.out_dir}")
    return 0


def _ocr_bias(spark: SparkSession, args: argparse.Namespace) -> int:
    pairs = readers.read_json(spark, args.pairs, schemas.OCR_PAIR)
    texts = pairs.select(F.col("clean").alias("text")).unionByName(pairs.select(F.col("ocr").alias("text")))
    scorer = _scorer(args.scorer) or _stand_in(spark, args, texts)
    summary = ocr_bias(pairs, scorer).join(audit.error_summary(pairs).select("median_error", "worst_error"))
    print(summary.toJSON().first())
    return 0


_COMMANDS = {"count": _count, "extract": _extract, "score": _score, "bino": _bino, "check": _check, "calibrate": _calibrate, "generate": _generate, "build-corpus": _build_corpus, "ocr-bias": _ocr_bias}


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
