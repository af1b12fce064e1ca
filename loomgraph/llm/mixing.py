"""Documents drawn so that each source gets a wanted share of all tokens.

Sizes are tokens of a public tokenizer.  A source with budget b and t tokens is
taken whole floor(b / t) times; what is left of its budget is filled by
Efraimidis-Spirakis sampling: each document has the key -ln(u) / w with u from a
hash of its id and w its quality weight, and documents are taken by rising key up
to the left budget.

Keys are cut into CELLS ranges.  The tokens of a source's ranges are summed first;
ranges wholly below the budget are taken, and only the one range in which the
budget ends is put in order.  So no source, however large, is sorted in one task.
"""

from __future__ import annotations

import base64
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed, parallel

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary cuts text ahead of merging (its published pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CELLS = 4096
SEED = 20260101
#: Texts are encoded in pieces of at most this many characters, cut at blanks, so that time and memory grow with length.
PIECE = 1 << 16


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, weight): the size of each document and its quality weight.

    The weight, from 0.05 to 1, is the share of letters, digits and blanks among a
    text's characters, lower for texts under 200 characters.  A null or empty text
    has no token; a null source is ''.
    """
    schema = "doc_id bigint, source string, n_tokens bigint, weight double"

    def run(batches):
        import tiktoken

        path = Path(folder) / vocabulary
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.read_bytes().splitlines())}
        encoder = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts, weights = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                n, at = 0, 0
                while at < len(text):
                    end = min(at + PIECE, len(text))
                    if end < len(text):
                        cut = text.rfind(" ", at + 1, end)
                        end = cut if cut > at else end
                    n += len(encoder.encode_ordinary(text[at:end]))
                    at = end
                counts.append(n)
                plain = sum(c.isalnum() or c.isspace() for c in text)
                weights.append(max(0.05, plain / max(len(text), 1) * min(1.0, len(text) / 200)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("source"), pa.array(counts, pa.int64()), pa.array(weights)], ["doc_id", "source", "n_tokens", "weight"])

    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    return parallel(rows).mapInArrow(run, schema)


def budgets(sizes: list[tuple[str, int]], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, tuple[float, int]]:
    """(tokens, repeats at most) of each wanted source that has documents.

    Shares of sources without documents fall to the others in proportion.  Without a
    total, it is the most at which every source can give its share within its
    repeats; with one, a source that can't gives all it may.
    """
    have = {s: n for s, n in sizes if n > 0}
    wanted = [(s, share, repeats) for s, share, repeats in targets if s in have and share > 0 and repeats > 0]
    whole = sum(share for _, share, _ in wanted)
    if not wanted:
        return {}
    if total is None:
        total = min(have[s] * repeats * whole / share for s, share, repeats in wanted)
    return {s: (min(total * share / whole, have[s] * float(repeats)), repeats) for s, share, repeats in wanted}


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, folder: str = TOKENIZERS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of every document drawn.

    `targets` has source, target_share and max_repeats, one row a source; a null
    source there stands for documents without one.
    """
    spark = documents.sparkSession
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    sized = checkpointed(token_counts(documents, folder).where("n_tokens > 0").withColumn("key", -F.log(u) / F.col("weight")))
    wanted = [(r["source"] or "", float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.collect()]
    # One row per wanted source.
    sizes = [(r["source"], int(r["n"])) for r in sized.where(F.col("source").isin([s for s, _, _ in wanted])).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()]
    plan = []
    have = dict(sizes)
    for source, (budget, repeats) in sorted(budgets(sizes, wanted, total).items()):
        epochs = min(int(budget // have[source]), repeats)
        plan.append((source, epochs, max(budget - epochs * have[source], 0.0) if epochs < repeats else 0.0))
    plans = F.broadcast(spark.createDataFrame(plan, "source string, epochs int, rest double"))
    # Ranges of rising keys: 1 - exp(-key / 4) runs evenly enough from 0 to 1 for weights from 0.05 to 1.
    cell = F.floor((F.lit(1.0) - F.exp(-F.col("key") / 4)) * CELLS).cast("int")
    placed = sized.join(plans, "source").withColumn("cell", cell)
    cells = placed.groupBy("source", "cell").agg(F.sum("n_tokens").alias("in_cell"))
    before = cells.withColumn("upto", F.sum("in_cell").over(Window.partitionBy("source").orderBy("cell"))).join(plans, "source")
    # The one range of each source in which its budget ends.
    edge = before.where("upto - in_cell <= rest and upto > rest").select("source", F.col("cell").alias("edge"), (F.col("rest") - F.col("upto") + F.col("in_cell")).alias("room"))
    placed = placed.join(F.broadcast(edge), "source", "left")
    full = F.when(F.col("rest") <= 0, 0).when(F.col("edge").isNull(), 1).when(F.col("cell") < F.col("edge"), 1).otherwise(0)
    inside = placed.where("cell = edge").withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.withColumn("extra", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("room")).cast("int"))
    others = placed.where("edge is null or cell != edge").withColumn("extra", full)
    columns = ["doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).alias("repeats")]
    return others.select(*columns).unionByName(last.select(*columns)).where("repeats > 0")


def shares(documents: DataFrame, targets: DataFrame, total: float | None = None, folder: str = TOKENIZERS) -> DataFrame:
    """Per wanted source: target share, documents and tokens drawn, most repeats, and the share reached; zeros where a source has no document."""
    drawn = mix(documents, targets, total, folder).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    wanted = targets.select(F.coalesce("source", F.lit("")).alias("source"), "target_share", "max_repeats")
    joined = wanted.join(drawn, "source", "left").na.fill(0, ["documents", "tokens", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy())
    return joined.select("source", "target_share", "max_repeats", "documents", "tokens", "most_repeats", F.round(F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0), 6).alias("share"))
