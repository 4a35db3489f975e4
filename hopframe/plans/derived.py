"""Question-answering tables derived from the star schema.

The given test data holds no questions, so the corpora of the engine are
derived from it: every customer, order and supplier gives questions.  All
tables grow with their sources and are built with key joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hopframe.functions.text import strip_lines, token_count
from hopframe.operators.examples import EXAMPLE_BUILDERS, prepare
from hopframe.operators.facts import lookup_facts, resolve_facts

MODELS = ("t5-small", "flan-t5-small", "opt-125m")
STRATEGIES = ("direct", "self_ask", "chain_of_thought")


# Schemas of tables already seen; reading a footer again would be a job of its own.
_KNOWN_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _KNOWN_SCHEMAS:
        _KNOWN_SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_KNOWN_SCHEMAS[path]).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Scan rows over all cores where the files give fewer splits than that.

    The text work behind it is heavy per byte.  A table of many splits is left
    as it is; ``key`` is unique, so the parts are even.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key) if df.rdd.getNumPartitions() < parts else df


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer with nation and region names."""
    return spark.sql(
        """
        SELECT c_custkey, c_name, c_mktsegment, n_name, r_name
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
             JOIN {region} ON n_regionkey = r_regionkey
        """,
        customer=spread(table(spark, sf_dir, "customer"), "c_custkey"),
        **{t: table(spark, sf_dir, t) for t in ("nation", "region")},
    )


def _customer_par(p: str) -> str:
    return (
        f"named_struct('title', {p}.c_name, 'sentences', array("
        f"concat({p}.c_name, ' belongs to the nation ', {p}.n_name, '.'),"
        f"concat({p}.c_name, ' trades in ', {p}.c_mktsegment, '.')))"
    )


def _nation_par(p: str) -> str:
    return (
        f"named_struct('title', {p}.n_name, 'sentences', array("
        f"concat({p}.n_name, ' lies in the region ', {p}.r_name, '.'),"
        f"concat({p}.n_name, ' is a trading nation.')))"
    )


def _refs(*pairs: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('title', {t}, 'sent_id', {i})" for t, i in pairs) + ")"


def _triples(*triples: tuple[str, str, str]) -> str:
    return "array(" + ", ".join(
        f"named_struct('subject', {s}, 'relation', '{r}', 'object', {o})" for s, r, o in triples
    ) + ")"


# Planted faults among the compositional questions: a sentence that is not there
# (every 97th), a sentence without the answer (every 17th), a repeated row (every 50th).
_COMPOSITIONAL = f"""
    SELECT concat('c', c.c_custkey, copy) AS id, c.c_custkey * 8 + length(copy) AS pos, c.c_custkey AS n,
           concat('Which region does the nation of ', c.c_name, ' lie in?') AS question,
           c.r_name AS answer, 'compositional' AS type,
           {_refs(('c.c_name', '0'),
                  ('c.n_name', 'CASE WHEN c.c_custkey % 97 = 0 THEN 9 WHEN c.c_custkey % 17 = 0 THEN 1 ELSE 0 END'))}
             AS supporting_facts,
           filter(array({_customer_par('c')}, {_nation_par('c')}, {_customer_par('d')}), p -> p.title IS NOT NULL)
             AS context,
           {_triples(('c.c_name', 'country of citizenship', 'c.n_name'), ('c.n_name', 'country', 'c.r_name'))}
             AS evidences
    FROM {{cust}} c LEFT JOIN {{cust}} d ON d.c_custkey = c.c_custkey + 7
         LATERAL VIEW explode(IF(c.c_custkey % 50 = 0, array('', 'd'), array(''))) AS copy
"""

_INFERENCE = f"""
    SELECT concat('o', o.o_orderkey) AS id, o.o_orderkey * 8 + 2 AS pos, o.o_orderkey AS n,
           concat('Which nation does the customer of ', o.title, ' belong to?') AS question,
           c.n_name AS answer, 'inference' AS type,
           {_refs(('o.title', '0'), ('o.title', '1'), ('c.c_name', '0'))} AS supporting_facts,
           array(named_struct('title', o.title, 'sentences', array(
                   concat(o.title, ' was placed by ', c.c_name, '.'), concat(o.title, ' was placed on ', o.day, '.'))),
                 {_customer_par('c')}, {_nation_par('c')}) AS context,
           {_triples(('o.title', 'customer', 'c.c_name'), ('o.title', 'inception', 'o.day'),
                     ('c.c_name', 'country of citizenship', 'c.n_name'))} AS evidences
    FROM (SELECT o_orderkey, o_custkey, concat('Order ', o_orderkey) AS title,
                 date_format(o_orderdate, 'yyyy-MM-dd') AS day FROM {{orders}}) o
         JOIN {{cust}} c ON o.o_custkey = c.c_custkey
"""

_COMPARISON = f"""
    SELECT concat('s', a.s_suppkey) AS id, a.s_suppkey * 8 + 3 AS pos, a.s_suppkey AS n,
           concat('Who has the larger account balance, ', a.s_name, ' or ', b.s_name, '?') AS question,
           CASE WHEN b.s_acctbal > a.s_acctbal THEN b.s_name ELSE a.s_name END AS answer,
           'comparison' AS type,
           {_refs(('a.s_name', '0'), ('b.s_name', '0'))} AS supporting_facts,
           array(named_struct('title', a.s_name, 'sentences', array(concat(a.s_name, ' has an account balance of ', a.bal, '.'))),
                 named_struct('title', b.s_name, 'sentences', array(concat(b.s_name, ' has an account balance of ', b.bal, '.'))))
             AS context,
           {_triples(('a.s_name', 'balance', 'a.bal'), ('b.s_name', 'balance', 'b.bal'))} AS evidences
    FROM {{supp}} a JOIN {{supp}} b ON b.s_suppkey = a.s_suppkey + 1
"""

_BRIDGE = f"""
    SELECT concat('b', a.c_custkey) AS id, a.c_custkey * 8 + 4 AS pos, a.c_custkey AS n,
           concat('Are ', a.c_name, ' and ', b.c_name, ' from the same region?') AS question,
           IF(a.r_name = b.r_name, 'yes', 'no') AS answer, 'bridge_comparison' AS type,
           {_refs(('a.c_name', '0'), ('a.n_name', '0'), ('b.c_name', '0'), ('b.n_name', '0'))} AS supporting_facts,
           array({_customer_par('a')}, {_nation_par('a')}, {_customer_par('b')}, {_nation_par('b')}) AS context,
           {_triples(('a.c_name', 'country of citizenship', 'a.n_name'), ('a.n_name', 'country', 'a.r_name'),
                     ('b.c_name', 'country of citizenship', 'b.n_name'), ('b.n_name', 'country', 'b.r_name'))}
             AS evidences
    FROM {{cust}} a JOIN {{cust}} b ON b.c_custkey = a.c_custkey + 1
"""


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main corpus: four question types over all customers, orders and suppliers."""
    supp = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "s_name", "s_acctbal", "cast(cast(s_acctbal AS decimal(12,2)) AS string) AS bal"
    )
    return spark.sql(
        " UNION ALL ".join((_COMPOSITIONAL, _INFERENCE, _COMPARISON, _BRIDGE)),
        cust=customers(spark, sf_dir), supp=supp,
        orders=spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey"),
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_BRIDGE, cust=customers(spark, sf_dir))


def hotpot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions without triples but with a difficulty level."""
    level = F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("n") % 3 + 1).cast("int"))
    return wiki(spark, sf_dir).withColumn("level", level).drop("evidences")


def celebrities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-step questions with their sub-questions spelled out, one per customer."""
    return customers(spark, sf_dir).selectExpr(
        "concat('c', c_custkey) AS id",
        "concat('Which region does the nation of ', c_name, ' lie in?') AS question",
        "array(r_name) AS answers",
        "concat('What is the nation of ', c_name, '?') AS q1", "array(n_name) AS a1",
        "concat('What is the region of ', n_name, '?') AS q2", "array(r_name) AS a2",
    )


def strategyqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no questions with plain-text facts; answers as the raw files have them."""
    return bridge(spark, sf_dir).select(
        "id", "pos", "question", F.expr("IF(answer = 'yes', 'true', 'false') AS answer"),
        lookup_facts().alias("facts"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known names and their types."""
    return spark.sql(
        "SELECT n_name AS name, 'GPE' AS type FROM {nation} UNION ALL SELECT r_name, 'LOC' FROM {region}",
        nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"),
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction-style records: four input lines and a list of outputs."""
    return customers(spark, sf_dir).selectExpr(
        "concat('c', c_custkey) AS id",
        r"concat('Question: ', c_name, ' is a customer. Which region does ', c_name, ' trade in? \n(A)', r_name,"
        r"' (B)', n_name, '\n\nExplanation: ', c_name, ' belongs to ', n_name, '. ', n_name, ' lies in ',"
        r"r_name, '.') AS input",
        "array(r_name) AS output",
    )


def run_rows() -> list[dict]:
    """Ten run configurations: models x strategies and one perfect run."""
    grid = [(m, s) for m in MODELS for s in STRATEGIES] + [("t5-small", "self_ask")]
    return [
        {"run_no": i, "model": m, "strategy": s, "answer_first": False, "random_facts": False,
         "examplars": i % 2 == 1}
        for i, (m, s) in enumerate(grid)
    ]


def run_names() -> list[str]:
    """Identity of each run, numbered so that two runs may share a configuration."""
    return [
        f"{r['model']}-{r['strategy']}-answer_first={r['answer_first']}-random_facts={r['random_facts']}-"
        f"{'with' if r['examplars'] else 'without'}-examplars/{r['run_no']:02d}"
        for r in run_rows()
    ]


def runs(spark: SparkSession) -> DataFrame:
    schema = (
        "run_no int, model string, strategy string, answer_first boolean, random_facts boolean, "
        "examplars boolean, run_id string"
    )
    return spark.createDataFrame([(*r.values(), i) for r, i in zip(run_rows(), run_names())], schema)


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question its answer and its target under each trained strategy, in one pass."""
    resolved, _ = resolve_facts(wiki(spark, sf_dir))
    work = prepare(resolved, "wiki", ["self_ask", "chain_of_thought"], entities(spark, sf_dir))
    cols = []
    for s in STRATEGIES:
        prompt, target = EXAMPLE_BUILDERS[("wiki", s)](False)
        cols += [
            strip_lines(target).alias(f"{s}_target"),
            token_count(strip_lines(prompt)).alias(f"{s}_prompt_tokens"),
        ]
    return work.select("id", "pos", "n", "type", "answer", F.size("supporting_facts").alias("hops"), *cols)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up answers of the ten runs to every question, right to different degrees.

    Also carries the truth the response is scored against.
    """
    named = ", ".join(
        f"named_struct('run_id', '{name}', 'run_no', {r['run_no']}, 'strategy', '{r['strategy']}')"
        for r, name in zip(run_rows(), run_names())
    )
    pick = "CASE run.strategy " + " ".join(f"WHEN '{s}' THEN {s}_{{0}}" for s in STRATEGIES) + " END AS {1}"
    return (
        truths(spark, sf_dir)
        .withColumn("run", F.expr(f"explode(array({named}))"))
        .selectExpr(
            "run.run_id AS run_id", "run.run_no AS run_no", "run.strategy AS strategy", "id", "pos", "n", "type",
            "answer", "hops", pick.format("target", "target"), pick.format("prompt_tokens", "num_prompt_tokens"),
        )
        .withColumn("line", F.expr(r"trim(replace(target, '\n', ' '))"))
        .withColumn("response", F.expr(
            """
            CASE WHEN (n * 7 + run_no * 3) % 10 <= run_no THEN line
                 WHEN n % 5 = 0 THEN replace(line, answer, 'unknown')
                 WHEN n % 5 = 1 THEN answer
                 WHEN n % 5 = 2 THEN lower(line)
                 WHEN n % 5 = 3 THEN substring(line, 1, greatest(length(line) - 20, 0))
                 ELSE '' END
            """
        ))
        .drop("line")
    )


def set_examples(spark: SparkSession, sf_dir: str, sets: DataFrame) -> DataFrame:
    """The examples of test sets (test_set, set_strategy): each question with the target of the set's prompts."""
    held = sets.select("test_set", "set_strategy").distinct().agg(F.collect_list(F.struct("test_set", "set_strategy")).alias("sets")).select("sets").scalar()
    target = "CASE s.set_strategy " + " ".join(f"WHEN '{s}' THEN {s}_target" for s in STRATEGIES) + " END AS target"
    return truths(spark, sf_dir).withColumn("s", F.explode(held)).selectExpr("s.test_set AS test_set", "id", "n", "answer", target)


def set_responses(examples: DataFrame, crossed: DataFrame) -> DataFrame:
    """Made-up answers of every run on each of its test sets, fewer right ones on foreign sets."""
    asked = examples.join(crossed.select("run_id", "run_no", "own_set", "test_set"), "test_set")
    return asked.withColumn("line", F.expr(r"trim(replace(target, '\n', ' '))")).selectExpr(
        "run_id", "test_set", "id",
        """CASE WHEN own_set AND (n * 7 + run_no * 3) % 10 <= run_no THEN line WHEN NOT own_set AND (n * 3 + run_no * 7 + 4) % 10 < run_no THEN line
             WHEN n % 5 = 1 THEN answer WHEN n % 5 = 2 THEN replace(line, answer, 'unknown') ELSE '' END AS response""",
    )


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long attention table from the embeddings: one row per vector position."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("long").alias("id"),
        F.lit(0).alias("layer"),
        (F.col("vec_id") % 10).cast("int").alias("head"),
        F.col("label").alias("out_pos"),
        F.posexplode("embedding").alias("in_pos", "value"),
    ).select(
        "id", "layer", "head", "out_pos", "in_pos", F.round(F.abs(F.col("value").cast("double")), 6).alias("weight")
    )


def decoder_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention of ten output positions per text and head."""
    place = F.col("id") % 10
    return attention(spark, sf_dir).select(
        F.floor(F.col("id") / 10).cast("long").alias("id"), "layer", "head", place.cast("int").alias("out_pos"), "in_pos", "weight"
    )


def token_name(position: Column) -> Column:
    """Token at a position: every third one starts a word."""
    text = position.cast("string")
    return F.when(position % 3 == 0, F.concat(F.lit("▁w"), text)).otherwise(F.concat(F.lit("s"), text))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as prompt and target: a user turn and the assistant's next one."""
    c = table(spark, sf_dir, "conversations")
    user = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    reply = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target")
    )
    return user.join(reply, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", "prompt", "target",
    )


def all_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a prompt, with the assistant's direct reply as target, else an empty text."""
    c = table(spark, sf_dir, "conversations")
    reply = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(reply, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("prompt"), F.coalesce("reply", F.lit("")).alias("target"),
    )
