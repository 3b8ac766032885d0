"""Language identification by compression.

Text of each language is a raw-content zstandard dictionary. A text is compressed with every dictionary; the
language whose dictionary makes it smallest wins, unless the next one is nearly as small.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import prepare

#: Bytes of text in a language's dictionary.
DICTIONARY_BYTES = 128 << 10
#: Texts wanted for a dictionary; about four times as many are drawn, by a hash of their text.
SAMPLE_TEXTS = 400
#: Characters compressed at a time: every piece of a long text meets the dictionary afresh.
PIECE = 1024
#: Relative margin between the two smallest sizes under which a decision is not reliable.
MARGIN = 0.02
LEVEL = 9


def learn(docs: DataFrame, text: str, lang: str, sample_texts: int = SAMPLE_TEXTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary of at most ``size`` bytes for every language that a text is labelled with.

    Only rows with text and language count. The sample is drawn by a hash of the text, so that it does not depend on
    the order of rows and takes repeated texts once. At most about 4 * ``sample_texts`` texts a language reach the
    driver, each cut to ``size`` bytes.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    shares = [x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, 4 * sample_texts / n)))]
    drawn = (
        rows.filter(draw < F.create_map(*shares)[F.col("lang")])
        .select("lang", draw.alias("draw"), F.substring("text", 1, size).alias("text")).distinct().collect()
    )
    by_lang: dict[str, list] = {}
    for r in sorted(drawn, key=lambda r: (r["draw"], r["text"])):
        by_lang.setdefault(r["lang"], []).append(r["text"].lower().encode())
    # The end of a raw dictionary is the cheapest to refer to; which texts stand there is a matter of the draw.
    return {name: b"\n".join(texts)[:size] for name, texts in by_lang.items()}


def classify(docs: DataFrame, text: str, dictionaries: dict[str, bytes], *keep: Column, margin: float = MARGIN) -> DataFrame:
    """The columns ``keep``, lang_pred, score and reliable, row by row over whole texts.

    score is the relative difference between the two smallest sizes, 0 to 1; with one language it is 1. Equal sizes
    go to the first language by name. Null texts, texts without a letter and everything when no language was
    learned are ``und`` with score 0. reliable is false for ``und`` and for scores below ``margin``.
    """
    spark = docs.sparkSession
    prepare(spark)
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keep, F.when(has_letter, F.col(text)).alias("_lang_text"))
    schema = rows.drop("_lang_text").schema.add("lang_pred", "string").add("score", "double").add("reliable", "boolean")
    shared = spark.sparkContext.broadcast(sorted(dictionaries.items()))

    def apply(batches):
        coders = []
        for name, data in shared.value:
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            coders.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False)))

        def decide(text):
            if text is None or not coders:
                return "und", 0.0
            text = text.lower()
            pieces = [text[i : i + PIECE].encode() for i in range(0, len(text), PIECE)]
            sizes = sorted((sum(len(c.compress(p)) for p in pieces), name) for name, c in coders)
            if len(sizes) == 1:
                return sizes[0][1], 1.0
            return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]

        for batch in batches:
            found = [decide(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            names, scores = [x[0] for x in found], [x[1] for x in found]
            sure = [n != "und" and s >= margin for n, s in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure)], names=schema.names
            )

    return rows.mapInArrow(apply, schema)
