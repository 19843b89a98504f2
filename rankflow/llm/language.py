"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from labelled
texts. A text is compressed once with each dictionary; the language whose
dictionary gives the fewest bytes wins. The margin is the share of bytes that
it saves over the runner-up: a narrow one rejects the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches

SAMPLE_DOCS = 400            # distinct labelled texts per language that may enter its dictionary
SAMPLE_CHARS = 2_000         # characters taken from each of them
DICT_BYTES = 256 << 10       # size of a dictionary
LEVEL = 3
MIN_MARGIN = 0.0005          # below this share of saved bytes, practically a tie, a document is rejected
UNKNOWN = "und"


# lower-cased UTF-8 with every ASCII byte that is no letter as a blank
_BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normalized(text: str) -> bytes:
    """What is compressed: case, digits and punctuation say little of a language."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKED).split())


def _last_hash(wanted: int, n: int) -> int:
    """Signed 64-bit hashes up to this one are ``wanted`` of ``n`` on average, all if there are no more."""
    return (1 << 63) - 1 if n <= wanted else (wanted << 64) // n - (1 << 63)


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang",
        sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
        dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw dictionaries by language, from a bounded sample: for each language
    the ``sample_docs`` distinct labelled texts (the first ``sample_chars``
    characters of each) of the smallest hash, ``dict_bytes`` in all. Copies
    count once, also for a language's share. Rows without text, letter or
    language are not learned from."""
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = (usable.select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), 1, sample_chars).alias("piece"))
            .withColumn("turn", F.xxhash64("piece")))
    counts = {r["lang"]: r["n"] for r in
              rows.select("lang", "turn").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # a language's share of hashes is set so that about 8 * sample_docs distinct
    # texts pass: what reaches one task does not grow with the corpus
    last = F.create_map(*[x for lang, n in counts.items()
                          for x in (F.lit(lang), F.lit(_last_hash(8 * sample_docs, n)))])[F.col("lang")]
    w = Window.partitionBy("lang").orderBy("turn", "piece")
    rows = (rows.filter(F.col("turn") <= last)
            .distinct().withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= sample_docs)
            .orderBy("lang", "rn").collect())
    texts: dict[str, list[bytes]] = {}
    for r in rows:
        texts.setdefault(r["lang"], []).append(normalized(r["piece"]))
    return {lang: b"\n".join(pieces)[:dict_bytes] for lang, pieces in sorted(texts.items())}


def classifier(dictionaries: dict[str, bytes], level: int = LEVEL):
    """``f(text) -> (language, score, margin)``; ties go to the first language
    in code point order. The score is the winner's share of the sum of the
    two shortest lengths' inverses, stretched to 0..1."""
    import regex
    import zstandard
    letter = regex.compile(r"\p{L}")
    names = sorted(dictionaries)
    coders = []
    for name in names:
        d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False,
                                               write_dict_id=False))

    def classify(text: str | None) -> tuple[str, float, float]:
        if text is None or not coders or not letter.search(text):
            return UNKNOWN, 0.0, 0.0
        data = normalized(text)
        sizes = [len(c.compress(data)) for c in coders]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        if len(order) == 1:
            return names[order[0]], 1.0, 1.0
        margin = 1 - best / sizes[order[1]]
        return names[order[0]], 0.5 + 0.5 * min(1.0, 4 * margin), margin

    return classify


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col="text", min_margin: float = MIN_MARGIN,
             level: int = LEVEL, prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected`` added
    (``prefix`` before these names; input columns of the same names give way).
    ``lang_pred`` is ``und`` for a null text or one without a letter, and the
    row is then rejected, as it is when the margin is below ``min_margin``.
    The dictionaries are the only thing shipped to the tasks: at most
    ``DICT_BYTES`` per language."""
    names = [f"{prefix}{c}" for c in ("lang_pred", "score", "rejected")]
    keep = [c for c in docs.columns if c not in names]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(shared.value, level)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            found = [classify(t.as_py()) for t in text]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                 pa.array([x[0] == UNKNOWN or x[2] < min_margin for x in found], pa.bool_())],
                names=[*batch.schema.names, *names])
        give_back()

    out = docs.select(*keep)
    schema = T.StructType([*out.schema, T.StructField(names[0], T.StringType()),
                           T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return out.mapInArrow(run, schema)
