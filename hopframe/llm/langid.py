"""Language identification by compression.

Each language has a raw-content dictionary of text from labelled documents.  A
text is cut into pieces of a few kilobytes, each is compressed with every
dictionary, and the language with the smallest sum wins: text of the
dictionary's language finds longer matches.  Pieces keep the dictionary in
play however long a text is; all pieces count.

The score falls from 1 as the runner-up comes close; ``narrow`` marks
predictions whose margin is below ``margin`` of the size, which a filter
should reject.  The fit uses at most ``docs_per_language`` documents of each
language and ``dictionary_bytes`` of text; both are parameters.

Nulls: a null text or one without a letter is ``und`` with score 0.  Rows
without a language are not learned from.  Ties go to the language with more
documents.  Without any labelled row everything is ``und``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm._sample import sample_per_class

DOCS_PER_LANGUAGE = 600
SNIPPET = 400
DICTIONARY_BYTES = 110_000
PIECE = 2048
LEVEL = 6
MARGIN = 0.005
UNKNOWN = "und"


def learn(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary), languages with most documents first.  ``rows`` are the labelled ones."""
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    order = [r[0] for r in known.groupBy(lang).count().orderBy(F.desc("count"), lang).collect()]  # one row per language
    span = F.greatest(F.length(text) - SNIPPET + 1, F.lit(1))
    cut = F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(key), F.lit(5)), span) + 1).cast("int"), F.lit(SNIPPET))
    taken = sample_per_class(known.select(key, lang, cut.alias("snippet")), lang, key, docs_per_language)
    parts: dict[str, list[str]] = {}
    for row in taken.orderBy(lang, F.xxhash64("snippet")).collect():  # bounded by docs_per_language
        parts.setdefault(row[lang], []).append(row["snippet"].lower())
    return [(name, "\n".join(parts.get(name, [])).encode()[-dictionary_bytes:]) for name in order]


class Classifier:
    """Compressors of all languages; built once in a task."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        import zstandard as z

        self.names = [name for name, _ in dictionaries]
        settings = z.ZstdCompressionParameters.from_level(
            LEVEL, min_match=3, strategy=z.STRATEGY_LAZY2, window_log=18, write_checksum=0, write_content_size=0, write_dict_id=0
        )
        self.packers = []
        for _, content in dictionaries:
            words = z.ZstdCompressionDict(content if len(content) >= 8 else content.ljust(8), dict_type=z.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=settings)
            self.packers.append(z.ZstdCompressor(dict_data=words, compression_params=settings))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode()
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(p.compress(x)) for x in pieces) for p in self.packers]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.names or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sorted(sizes[:best] + sizes[best + 1 :])
        scale = max(2.0, 0.01 * sizes[best])
        score = 1.0 / (1.0 + sum(2.0 ** (-min((s - sizes[best]) / scale, 500.0)) for s in rest))
        narrow = bool(rest) and rest[0] - sizes[best] < max(1.0, MARGIN * sizes[best])
        return self.names[best], score, narrow


def predict(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score and narrow."""
    kept = docs.select(*keep, F.col(text).alias("__text"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches):
        judge = Classifier(dictionaries)
        for batch in batches:
            found = [judge.predict(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            names, scores, narrow = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())],
                [*keep, "lang_pred", "score", "narrow"],
            )

    return kept.mapInArrow(run, f"{columns}, lang_pred string, score double, narrow boolean")
