"""Registered queries: one per operator or pair of operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.functions import text as T
from hopframe.operators import analysis as an
from hopframe.operators import attention as att
from hopframe.operators import evaluate as ev
from hopframe.operators import exemplars as exm
from hopframe.operators import facts as fa
from hopframe.operators import filters as fl
from hopframe.operators import ordering as od
from hopframe.operators import overlap as ov
from hopframe.operators import pack as pk
from hopframe.operators import perturb as pt
from hopframe.operators import rationale as ra
from hopframe.operators import sections as se
from hopframe.operators.examples import causal_input, make_examples, make_exemplars, qa_split, with_token_counts
from hopframe.plans import builds, derived as D, grid
from hopframe.session import materialized, shared_dir
from hopframe.sources import sinks
from hopframe.sources.progress import Progress
from hopframe.streaming import scores as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LIMIT = 60  # token limit of the registered builds: part of the derived prompts is longer
METRICS_N = ("bleu_1", "bleu_2", "rouge_1", "rouge_2", "f1_1", "f1_2")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return fa.resolve_facts(D.wiki(spark, sf))[0]


def _flat(df: DataFrame) -> DataFrame:
    """Examples with the relation array as text."""
    return df.select(
        "id", "prompt", "target", "answer", *an.SIZE_COLUMNS, "hops", "type",
        F.array_join("relationships", "|").alias("relationships"),
    )


def _wiki_examples(spark: SparkSession, sf: str, strategy: str, **kw) -> DataFrame:
    return make_examples(_resolved(spark, sf), "wiki", strategy, entities=D.entities(spark, sf), **kw)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores without stemming or subsequence, which SQL can repeat."""
    return ev.rouge(ev.judge(D.responses(spark, sf)), use_stemmer=False, with_lcs=False)


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return ev.judge(D.responses(spark, sf))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return D.spread(D.table(spark, sf, "documents"), "doc_id")


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- prompts and targets ----------------------------------------------------


@query
def direct_examples(spark, sf):
    return _flat(_wiki_examples(spark, sf, "direct"))


@query
def self_ask_examples(spark, sf):
    return _flat(_wiki_examples(spark, sf, "self_ask"))


@query
def cot_examples(spark, sf):
    return _flat(_wiki_examples(spark, sf, "chain_of_thought"))


@query
def squad_examples(spark, sf):
    return _flat(_wiki_examples(spark, sf, "squad"))


@query
def answer_first_examples(spark, sf):
    parts = [
        _flat(_wiki_examples(spark, sf, s, answer_first=True)).withColumn("strategy", F.lit(s))
        for s in ("self_ask", "chain_of_thought")
    ]
    return an.union_all(parts)


def _exemplars(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    parts = [
        make_exemplars(_resolved(spark, sf), "wiki", strategy, first, D.entities(spark, sf))
        .withColumn("answer_first", F.lit(first))
        for first in (False, True)
    ]
    return an.union_all(parts)


@query
def self_ask_exemplars(spark, sf):
    return _exemplars(spark, sf, "self_ask")


@query
def cot_exemplars(spark, sf):
    return _exemplars(spark, sf, "chain_of_thought")


@query
def celebrity_examples(spark, sf):
    raw = D.celebrities(spark, sf)
    ex = make_examples(raw, "celebrities", "self_ask").select("id", "prompt", "target", "answer", *an.SIZE_COLUMNS)
    return ex.join(make_exemplars(raw, "celebrities", "self_ask").withColumnRenamed("text", "exemplar"), "id")


@query
def hotpot_examples(spark, sf):
    raw = fa.resolve_facts(D.hotpot(spark, sf))[0]
    ents = D.entities(spark, sf)
    both = make_examples(raw, "hotpot", ("self_ask", "direct"), entities=ents)
    return both.select(F.col("strategy").alias("form"), "id", "prompt", "target", "answer", *an.SIZE_COLUMNS)


@query
def hotpot_exemplars(spark, sf):
    raw = fa.resolve_facts(D.hotpot(spark, sf))[0]
    return make_exemplars(raw, "hotpot", "self_ask", entities=D.entities(spark, sf))


@query
def strategy_examples(spark, sf):
    forms = make_examples(D.strategyqa(spark, sf), "strategyqa", ("self_ask", "direct", "squad"))
    return forms.select(F.col("strategy").alias("form"), "id", "prompt", "target", "answer", *an.SIZE_COLUMNS)


def _pool(spark: SparkSession, sf: str, strategy: str = "self_ask", n: int = 20) -> DataFrame:
    shots, _ = od.split_exact(_resolved(spark, sf), n, 43)
    return make_exemplars(shots, "wiki", strategy, entities=D.entities(spark, sf))


@query
def few_shot_prompts(spark, sf):
    ex = _wiki_examples(spark, sf, "self_ask")
    return exm.with_exemplars(ex, _pool(spark, sf), 2, True, 42).select("id", "prompt", "num_prompt_tokens")


@query
def few_shot_per_row(spark, sf):
    ex = _wiki_examples(spark, sf, "chain_of_thought")
    pool = _pool(spark, sf, "chain_of_thought")
    return exm.with_exemplars(ex, pool, 2, False, 42).select("id", "prompt", "num_prompt_tokens")


@query
def joined_few_shot(spark, sf):
    ex = make_examples(D.celebrities(spark, sf), "celebrities", "self_ask")
    pool = make_exemplars(D.celebrities(spark, sf), "celebrities", "self_ask")
    return exm.joined_exemplars(ex, pool, 4, 42).select("id", "prompt", "target")


@query
def random_fact_order(spark, sf):
    return _wiki_examples(spark, sf, "direct", random_facts=True).select("id", "prompt")


@query
def facts_blocks(spark, sf):
    return _resolved(spark, sf).select(
        "id",
        fa.facts_block("facts", 1).alias("one_based"),
        fa.facts_block("facts", 0).alias("zero_based"),
        T.strip_lines(F.concat(F.lit("  "), fa.context_block("facts"))).alias("context"),
    )


@query
def sub_questions(spark, sf):
    ents = D.entities(spark, sf)
    wiki = ra.sub_questions(_resolved(spark, sf), "wiki", ents).select(
        F.lit("wiki").alias("source"), "id", F.posexplode("sub_questions").alias("step", "q"))
    hot = ra.sub_questions(fa.resolve_facts(D.hotpot(spark, sf))[0], "hotpot", ents).select(
        F.lit("hotpot").alias("source"), "id", F.posexplode("sub_questions").alias("step", "q"))
    return wiki.unionByName(hot).select("source", "id", "step", "q.question", "q.answer")


@query
def thoughts(spark, sf):
    return D.wiki(spark, sf).select("id", F.array_join(ra.thoughts(), "; ").alias("thoughts"))


@query
def token_counts(spark, sf):
    pairs = with_token_counts(D.all_turns(spark, sf))
    return pairs.select("id", *an.SIZE_COLUMNS)


@query
def qa_pairs(spark, sf):
    ex = _wiki_examples(spark, sf, "direct")
    return causal_input(qa_split(ex, triple=True))


@query
def evaluation_wide(spark, sf):
    ents = D.entities(spark, sf)
    pools = {"self_ask": _pool(spark, sf), "chain_of_thought": _pool(spark, sf, "chain_of_thought"),
             "squad": _pool(spark, sf)}
    wide = builds.evaluation_wide(_resolved(spark, sf), "wiki", pools, 2, 42, ents)
    return wide.withColumn("relationships", F.array_join("relationships", "|"))


@query
def strategy_wide(spark, sf):
    raw = D.strategyqa(spark, sf)
    return builds.evaluation_wide(raw, "strategyqa", {"self_ask": _pool(spark, sf)}, 2, 42)


@query
def parse_instances(spark, sf):
    out = se.parse_instances(D.instances(spark, sf))
    return out.select("id", F.array_join("evidences", "|").alias("evidences"), "question", "answer")


@query
def prompt_sections(spark, sf):
    ex = _wiki_examples(spark, sf, "self_ask")
    few = exm.with_exemplars(ex, _pool(spark, sf), 2, True, 42)
    return se.prompt_sections(few).select(
        "id", "facts_part", "question_part", "examples_tokens", "facts_tokens", "question_tokens")


# --- filters ----------------------------------------------------------------


@query
def token_filter(spark, sf):
    return fl.filter_tokens(_wiki_examples(spark, sf, "direct"), LIMIT).select("id", "num_prompt_tokens")


@query
def document_token_filter(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "source", T.token_count("text").alias("num_prompt_tokens"))
    return fl.filter_tokens(docs, 130).select("doc_id", "source", "num_prompt_tokens")


@query
def verify_answer(spark, sf):
    kept, rejects = fl.verify_answer(_wiki_examples(spark, sf, "direct"))
    return kept.select("id", "found_answer", F.lit(True).alias("kept")).unionByName(
        rejects.select("id", "found_answer", F.lit(False).alias("kept")))


@query
def verify_answer_strict(spark, sf):
    kept, rejects = fl.verify_answer(_wiki_examples(spark, sf, "self_ask"), "strict")
    return kept.select("id", "found_answer", F.lit(True).alias("kept")).unionByName(
        rejects.select("id", "found_answer", F.lit(False).alias("kept")))


@query
def allow_list_filter(spark, sf):
    allow = builds.allow_list(_resolved(spark, sf), LIMIT)
    return fl.keep_allowed(_wiki_examples(spark, sf, "self_ask"), allow).select("id", "prompt", "target")


@query
def merged_ids(spark, sf):
    ex = _wiki_examples(spark, sf, "direct")
    short = fl.filter_tokens(ex, LIMIT).select("id")
    return fl.merge_ids(short, fl.verify_answer(ex)[0].select("id"))


@query
def dedup_prompts(spark, sf):
    ex = _wiki_examples(spark, sf, "direct", keep=("pos",))
    kept, rejects = fl.dedup_prompts(ex)
    return kept.select("id", F.lit(True).alias("kept")).unionByName(rejects.select("id", F.lit(False).alias("kept")))


@query
def dedup_documents(spark, sf):
    kept, _ = fl.dedup_prompts(D.table(spark, sf, "documents"), "doc_id", "text")
    return kept.select("doc_id", "source", "n_chars")


@query
def date_category(spark, sf):
    flagged = fl.date_category(_documents(spark, sf), "text")
    return flagged.select("doc_id", *[f"has_{n}" for n in fl.DATE_PATTERNS], "any_date")


@query
def bad_fact_rejects(spark, sf):
    return fa.resolve_facts(D.wiki(spark, sf))[1].select("id", "type", "bad_ref")


@query
def facts_from_corpus(spark, sf):
    qa = D.wiki(spark, sf)
    corpus = qa.select("id", F.explode("context").alias("p")).select(
        "id", F.col("p.title").alias("title"), F.posexplode("p.sentences").alias("sent_id", "sentence")).distinct()
    good, _ = fa.resolve_facts_from_corpus(qa.drop("context"), corpus)
    return good.select("id", F.array_join("facts", "|").alias("facts"))


@query
def extract_answers(spark, sf):
    return D.responses(spark, sf).select(
        "run_id", "id",
        T.extract_answer("target", "target").alias("from_target"),
        T.extract_answer("response").alias("from_response"),
        T.extract_answer("response", "response", "text").alias("with_fallback"),
    )


@query
def self_ask_flag(spark, sf):
    return D.responses(spark, sf).select("run_id", "id", T.is_self_ask("response").alias("self_ask"))


@query
def correctness(spark, sf):
    return _judged(spark, sf).select("run_id", "id", "model_answer", "correct")


@query
def coverage_under_limit(spark, sf):
    ex = _wiki_examples(spark, sf, "self_ask")
    return _rounded(fl.coverage(ex, "num_tokens", 130, ["type"]), "share_under")


# --- scoring ----------------------------------------------------------------


@query
def rouge_n(spark, sf):
    return _rounded(_scores(spark, sf).select("run_id", "id", *METRICS_N), *METRICS_N)


@query
def rouge_turns(spark, sf):
    """Overlap of each user turn with its reply, stemmed, with the common subsequence."""
    pairs = D.turn_pairs(spark, sf)
    return _rounded(ev.rouge(pairs, "target", "prompt").select("id", *ev.METRICS), *ev.METRICS)


@query
def rouge_l(spark, sf):
    scored = ev.score(D.responses(spark, sf))
    return _rounded(scored.select("run_id", "id", *ev.METRICS), *ev.METRICS)


@query
def macro_results(spark, sf):
    """Run averages of every score: stemmed, with the common subsequence."""
    return ev.macro(ev.score(D.responses(spark, sf)))


@query
def leaderboard(spark, sf):
    board = an.leaderboard(ev.macro(_scores(spark, sf)), D.runs(spark).drop("run_no"))
    return an.mark_best(board)


@query
def model_means(spark, sf):
    board = an.leaderboard(ev.macro(_scores(spark, sf)), D.runs(spark))
    return _rounded(an.model_means(board), "accuracy", *METRICS_N)


@query
def evaluate_run(spark, sf):
    """Two-stage evaluation: a partial first attempt, then the rest, scored together."""
    # made once, as both attempts are read several times; only what tells rows apart and is judged is kept and moved
    rows = materialized(D.responses(spark, sf).select("run_id", "id", "pos", "n", "type", "answer", "hops", "response"), "responses")
    first = rows.where(F.col("n") % 4 != 3)
    todo = ev.pending(rows, first)
    both = ev.append_new(first, todo)
    judged = ev.judge(both)
    return judged.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("answered"),
        F.count_if("correct").alias("right"),
        F.count_if("self_ask").alias("self_asked"),
    )


@query
def resume_eval(spark, sf):
    rows = D.responses(spark, sf)
    return ev.pending(rows, rows.where(F.col("n") % 4 != 3)).select("run_id", "id")


@query
def completeness(spark, sf):
    rows = D.responses(spark, sf).select("run_id", "id", "n", "type")
    stray = rows.where(F.col("n") % 4 != 3).withColumn(
        "id", F.when((F.col("n") == 0) & (F.col("type") == "inference"), F.lit("unknown")).otherwise(F.col("id")))
    return ev.completeness(rows, stray)


@query
def generated_stub(spark, sf):
    """A user function in place of a model: answers each prompt by its last line."""
    ex = _wiki_examples(spark, sf, "direct")
    return ev.generate(ex, lambda s: s.str.split("\n").str[-2].str.upper(), batch_size=1000).select("id", "response")


@query
def normalized_targets(spark, sf):
    ex = _wiki_examples(spark, sf, "self_ask")
    return ev.normalize(ex.select("id", "answer", "target"), ["answer", "target"])


@query
def progress_counts(spark, sf):
    """Two batches of responses with their processed targets, some not processed, and a third whose writer was killed."""
    rows = D.responses(spark, sf)
    progress = Progress(spark, shared_dir(spark, "progress"))
    for k in (0, 1):
        part = rows.where(F.col("n") % 4 == k)
        progress.save(part, part.where(F.col("n") % 8 != 1), k)
    progress.write("responses", rows.where(F.col("n") % 4 == 2).select("run_id", "id", "response"), 2)
    return progress.completeness(rows)


@query
def stream_scores(spark, sf):
    """All responses arriving as files, some of them twice, scored once each."""
    rows = D.responses(spark, sf)
    base = shared_dir(spark, "stream")
    # arrival times come from the events; a question takes the event of its own number
    events = D.table(spark, sf, "events").select(F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("ts"))
    arrived = rows.join(events, "n", "left").withColumn(
        "arrived", F.coalesce("ts", F.timestamp_micros(F.lit(1704067200000000) + F.col("n") * 1000000)))
    copies = F.sequence(F.lit(1), F.when(F.col("n") % 20 == 0, 2).otherwise(1))
    (arrived.withColumn("copy", F.explode(copies)).select("run_id", "id", "response", "arrived")
     .write.parquet(f"{base}/in"))
    truth = rows.select("run_id", "id", "answer", "target")
    job = st.stream_scores(
        st.response_stream(spark, f"{base}/in"), truth, f"{base}/out", f"{base}/state", use_stemmer=False)
    job.awaitTermination()
    return _rounded(
        st.stored_scores(spark, f"{base}/out").select("run_id", "id", "correct", "self_ask", *METRICS_N), *METRICS_N)


# --- analysis ---------------------------------------------------------------


@query
def token_stats(spark, sf):
    parts = [
        _wiki_examples(spark, sf, s).select(F.lit(s).alias("strategy"), *an.SIZE_COLUMNS)
        for s in ("self_ask", "direct")
    ]
    return an.token_stats(an.union_all(parts), ["strategy"])


@query
def document_token_stats(spark, sf):
    docs = _documents(spark, sf).select("lang", T.token_count("text").alias("num_tokens"))
    return an.token_stats(docs, ["lang"], ("num_tokens",))


@query
def stage_counts(spark, sf):
    return an.stage_counts(_wiki_examples(spark, sf, "direct"), LIMIT, ["type"])


@query
def context_corr(spark, sf):
    return _rounded(an.context_corr(_scores(spark, sf), metrics=METRICS_N), "correct", *METRICS_N)


def _wide(spark: SparkSession, sf: str, value: str = "correct") -> DataFrame:
    return an.runs_wide(_judged(spark, sf), D.run_names(), value)


@query
def run_corr(spark, sf):
    return _rounded(an.run_corr(_wide(spark, sf), D.run_names()), "corr")


@query
def conditional_agreement(spark, sf):
    return _rounded(an.conditional_agreement(_wide(spark, sf), D.run_names()), "share")


@query
def runs_wide(spark, sf):
    wide = _wide(spark, sf)
    return wide.select("id", *[F.col(f"`{r}`").alias(f"run_{i}") for i, r in enumerate(D.run_names())])


@query
def accuracy_by_type(spark, sf):
    return _rounded(an.accuracy_by_type(_judged(spark, sf)), "share_wrong", "share_right")


@query
def type_accuracy_corr(spark, sf):
    return _rounded(an.type_corr(_judged(spark, sf), D.run_names()), "corr")


@query
def self_ask_rate(spark, sf):
    return _rounded(an.self_ask_rate(_judged(spark, sf)), "self_ask_rate")


@query
def value_counts(spark, sf):
    qa = D.hotpot(spark, sf)
    return an.union_all([
        _rounded(an.value_counts(qa, c), "share").withColumn("column", F.lit(c)) for c in ("type", "level")
    ])


@query
def label_counts(spark, sf):
    labels = D.table(spark, sf, "labels")
    return labels.groupBy("quality").pivot("toxic", [0, 1]).count().select(
        "quality", F.coalesce("0", F.lit(0)).alias("not_toxic"), F.coalesce("1", F.lit(0)).alias("toxic"))


@query
def relation_freq(spark, sf):
    return an.relation_freq(D.wiki(spark, sf))


@query
def first_per_relation(spark, sf):
    return an.first_per_relation(D.wiki(spark, sf))


@query
def context_hist(spark, sf):
    return _rounded(an.context_hist(_judged(spark, sf)), "mean_size")


@query
def compositionality_gap(spark, sf):
    """Sub-questions count as right where their answer occurs in the response."""
    ents = D.entities(spark, sf)
    # steps travel as one row per question, and each response leaves the join with all its rows
    subs = ra.sub_questions(_resolved(spark, sf), "wiki", ents).groupBy("id").agg(
        F.flatten(F.collect_list("sub_questions.answer")).alias("steps"))
    judged = _judged(spark, sf).select("run_id", "id", "response", "correct").join(subs, "id", "left")
    main = F.array(F.struct(F.lit(False).alias("is_sub"), F.col("correct")))
    found = F.transform("steps", lambda s: F.struct(F.lit(True).alias("is_sub"), F.contains("response", s).alias("correct")))
    rows = judged.select("run_id", "id", F.inline(F.concat(main, F.coalesce(found, F.filter(main, lambda r: F.lit(False))))))
    return _rounded(an.compositionality_gap(rows, ["run_id"]), "gap")


@query
def aligned_scores(spark, sf):
    judged = _judged(spark, sf)
    scores = judged.select("run_id", "id", "correct")
    answers = judged.select("run_id", "id", "self_ask")
    questions = D.wiki(spark, sf).select("id", "type")
    aligned, _ = an.align(scores, answers, questions)
    return aligned.groupBy("run_id", "type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("correct").alias("right"), F.count_if("self_ask").alias("self_asked"))


def _keyed_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Key and score of every response: the texts need not travel to where rows are ranked."""
    return _scores(spark, sf).select(F.concat_ws("/", "run_id", "id").alias("key"), F.round("f1_2", 9).alias("f1_2"))


@query
def top_bottom_random(spark, sf):
    return od.extremes(_keyed_scores(spark, sf), "f1_2", 5, 0, "key").select(
        "section", "rank", "key", F.round("f1_2", 6).alias("f1_2"))


@query
def sample_report(spark, sf):
    """One report per run over all its responses, with every score and the whole texts."""
    ex = _wiki_examples(spark, sf, "self_ask", keep=("pos",)).select("id", "pos", "prompt")
    answers = D.responses(spark, sf).select("run_id", "id", "target", "response")
    rows = ev.rouge(answers.join(ex, "id"), use_stemmer=False).withColumn("f1_2", F.round("f1_2", 9))
    return sinks.sample_report(rows, "sample", by=("run_id",))


@query
def nth_ranked(spark, sf):
    return od.ranked_rows(_keyed_scores(spark, sf), "f1_2", [15, -1], "key").select(
        F.col("place").alias("k"), "key", F.round("f1_2", 6).alias("f1_2"))


@query
def middle_ranked(spark, sf):
    """Events in the middle of the order by value, far from either end."""
    rows = D.table(spark, sf, "events").select("event_id", F.col("value").cast("double").alias("value"))
    return od.ranked_rows(rows, "value", [500, 1000, 4321, -2000], "event_id").select("place", "event_id", "value")


# --- splits and batches -----------------------------------------------------


@query
def train_dev_split(spark, sf):
    dev, train = od.split_exact(D.wiki(spark, sf), 1256, 42)
    return dev.select("id", F.lit("dev").alias("split")).unionByName(train.select("id", F.lit("train").alias("split")))


@query
def exemplar_holdout(spark, sf):
    dev, train = od.split_exact(D.wiki(spark, sf), 1256, 42)
    shots, rest = od.split_exact(train, 50, 43)
    return an.union_all([
        d.groupBy("type").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id")).withColumn("part", F.lit(n))
        for n, d in (("dev", dev), ("exemplars", shots), ("train", rest))
    ])


@query
def chunks(spark, sf):
    return od.with_chunk(D.wiki(spark, sf), 15).select("id", "row_index", "chunk")


@query
def batches(spark, sf):
    return od.with_batch(D.wiki(spark, sf), 512, 3, keep_tail=False).select("id", "batch_id")


@query
def digest_batches(spark, sf):
    """Documents in batches by the order of a digest, as a shuffled epoch reads them."""
    rows = D.table(spark, sf, "documents").select("doc_id", T.seeded_key(42, "doc_id").alias("draw"))
    return od.with_batch(rows, 64, 2, key=["draw", "doc_id"]).select("doc_id", "row_index", "batch_id")


@query
def head_rows(spark, sf):
    return od.head_n(D.wiki(spark, sf), 100).select("id", "question")


@query
def packed_inputs(spark, sf):
    packed = pk.pack(D.all_turns(spark, sf))
    return packed.select("id", *[
        F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
        for c in ("input_ids", "attention_mask", "labels", "decoder_input_ids")
    ])


# --- overlap ----------------------------------------------------------------


def _sentences(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return (
        D.table(spark, sf, name).select(F.explode(F.split("text", r"[.\n]")).alias("s"))
        .select(F.trim("s").alias("sentence")).where(F.length("sentence") > 0)
    )


@query
def exact_overlap(spark, sf):
    wiki, other = D.wiki(spark, sf), D.celebrities(spark, sf).withColumn("answer", F.get("answers", F.lit(0)))
    return an.union_all([
        ov.exact_overlap(wiki, other, "answer").withColumn("what", F.lit("answers")),
        ov.exact_overlap(wiki, other, "question").withColumn("what", F.lit("questions")),
        ov.exact_overlap(_sentences(spark, sf, "documents"), _sentences(spark, sf, "benchmark"), "sentence")
        .withColumn("what", F.lit("sentences")),
    ])


@query
def shared_answer_pairs(spark, sf):
    other = D.celebrities(spark, sf).select("id", "question", F.get("answers", F.lit(0)).alias("answer"))
    return ov.shared_answer_pairs(D.wiki(spark, sf), other.withColumn("pos", F.col("id")))


@query
def fuzzy_pairs(spark, sf):
    return ov.fuzzy_pairs(_sentences(spark, sf, "documents"), _sentences(spark, sf, "benchmark"), "sentence", 80)


@query
def fuzzy_top5(spark, sf):
    return ov.fuzzy_top(_sentences(spark, sf, "benchmark"), _sentences(spark, sf, "documents"), "sentence", 5, 80)


# --- grids and builds -------------------------------------------------------


@query
def experiment_grid(spark, sf):
    """Every question beside every flag combination, counted per run and type."""
    runs = grid.run_grid(spark, list(D.MODELS))
    sizes = D.wiki(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("questions"))
    per_run = runs.withColumn("type", F.explode(F.array(*[F.lit(t) for t in ("compositional", "inference", "comparison", "bridge_comparison")])))
    return per_run.join(sizes, "type")


@query
def cross_evaluation(spark, sf):
    """Accuracy of each run on its own test set and on those of its strategy with other flags, scored against the set's examples."""
    crossed = grid.cross_runs(D.runs(spark))
    examples = D.set_examples(spark, sf, crossed)
    scored, _ = ev.evaluate_on(examples, D.set_responses(examples, crossed), with_rouge=False)
    macro = scored.groupBy("run_id", "test_set").agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"))
    return crossed.join(macro, ["run_id", "test_set"]).select("run_id", "test_set", "results_name", "questions", "accuracy")


def _grid() -> list[dict]:
    return grid.flag_grid()


@query
def test_build(spark, sf):
    ents = D.entities(spark, sf)
    res = _resolved(spark, sf)
    shots, _ = od.split_exact(res, 20, 43)
    table = builds.exemplar_table(shots, _grid(), entities=ents)
    built = builds.build_test_data(D.wiki(spark, sf), table, _grid(), LIMIT, entities=ents)
    return built.select(
        "id", "strategy", "answer_first", "random_facts", "examplars", F.md5("prompt").alias("prompt_md5"),
        F.md5("target").alias("target_md5"), "num_tokens")


@query
def finetuning_build(spark, sf):
    built, _ = builds.build_finetuning_data(
        D.wiki(spark, sf), _grid(), n_exemplars=20, dev_size=1256, limit=LIMIT, entities=D.entities(spark, sf))
    return built.groupBy("split", "strategy", "answer_first", "random_facts", "examplars").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("num_target_tokens").alias("target_tokens"),
        F.sum("num_prompt_tokens").alias("prompt_tokens"))


# --- attention and robustness -----------------------------------------------


def _words(spark: SparkSession, sf: str) -> DataFrame:
    total = att.sum_over_window(D.attention(spark, sf))
    soft = att.softmax_by(total, att.HEAD)
    return att.merge_words(soft.withColumn("token", D.token_name(F.col("in_pos"))))


@query
def attention_top_words(spark, sf):
    words = _words(spark, sf).withColumn("weight", F.round("weight", 9))
    return att.top_words(words, 5).select(*att.HEAD, "rank", "word", F.round("weight", 6).alias("weight"))


@query
def phrase_attention(spark, sf):
    weights = D.attention(spark, sf)
    tokens = weights.groupBy("id").agg(F.max("in_pos").alias("last")).select(
        "id", F.transform(F.sequence(F.lit(0), F.col("last")), lambda p: D.token_name(p)).alias("tokens"))
    hit = att.phrase_attention(weights, tokens, ["▁w3", "s4", "s5"])
    return hit.groupBy(*att.HEAD, "out_pos").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.sum("weight"), 6).alias("weight"))


@query
def phrase_top_words(spark, sf):
    """Attention of a phrase of three output positions, summed, softmax over the input, by words."""
    weights = D.decoder_attention(spark, sf)
    tokens = weights.groupBy("id").agg(F.max("out_pos").alias("last")).select(
        "id", F.transform(F.sequence(F.lit(0), F.col("last")), lambda p: D.token_name(p)).alias("tokens"))
    total = att.sum_over_window(att.phrase_attention(weights, tokens, ["▁w3", "s4", "s5"]))
    soft = att.softmax_by(total, att.HEAD).withColumn("token", D.token_name(F.col("in_pos")))
    words = att.merge_words(soft).withColumn("weight", F.round("weight", 9))
    return att.top_words(words, 5).select(*att.HEAD, "rank", "word", F.round("weight", 6).alias("weight"))


@query
def head_slices(spark, sf):
    part = att.select_slice(D.attention(spark, sf).withColumn("kind", F.lit("cross")), 0, 3, "cross")
    return part.groupBy("id", "in_pos").agg(F.round(F.sum("weight"), 6).alias("weight"))


def _answerable(df: DataFrame) -> DataFrame:
    """Outcome of a reader that only finds answers stated in the facts."""
    told = F.contains(F.array_join("facts", " "), F.col("answer"))
    picks_first = F.contains(F.col("question"), F.concat(F.lit(", "), F.col("answer"), F.lit(" or ")))
    return df.withColumn("correct", F.when(F.col("type") == "comparison", picks_first).otherwise(told))


@query
def perturb_flip_rate(spark, sf):
    base = _resolved(spark, sf).select("id", "type", "question", "answer", "facts")
    plain = _answerable(base).select("id", "correct")
    variants = an.union_all([
        _answerable(pt.perturb(base, k)).where("changed").select("id", F.lit(k).alias("kind"), "correct")
        for k in pt.KINDS
    ])
    return _rounded(pt.flip_rate(plain, variants), "flip_rate")


@query
def perturbed_prompts(spark, sf):
    base = _resolved(spark, sf).select("id", "question", "facts")
    return an.union_all([
        pt.perturb(base, k).where("changed").select(
            "id", F.lit(k).alias("kind"), "question", F.array_join("facts", "|").alias("facts"))
        for k in pt.KINDS
    ])


def queries() -> dict[str, Query]:
    return dict(QUERIES)

