"""Document fingerprints: a homomorphic multiset hash, in DataFrame operations alone.

A text is a multiset of paragraphs (lines), a paragraph one of phrases. The fingerprint is a sum of wide vectors, taken
modulo powers of two: eight 32-bit lanes of the paragraphs' SHA-256 tell texts apart whatever their order, and 128 lanes
of random signs, one vector for each phrase, tell how alike they are, since the cosine of two sums estimates the cosine
of the multisets. Vectors of added or removed paragraphs may be added or subtracted (`combine`), so a fingerprint follows
an edit without reading the text again: that is how `edited` gets those of edited texts.

Null texts count as empty (one empty paragraph). Every row is a document. In the order of the ids, rows that share an id
follow the order of a hash of their texts, and equal rows (same id, same text) have one place and the same result; a null
id, as which the least of all numbers counts too, comes first. Texts of any length are read whole; counts are kept modulo 2^32. Columns beyond doc_id and text are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, documents, partitions

#: Phrases end at line ends and at blanks after one of these characters, so an edit changes the phrases around it alone.
PHRASE_END = r"(?<=[adelnrst.,;:!?])\s+"
EQUAL_LANES, SIGN_LANES = 8, 128
TWO_LANES = 0x0000000100000001
#: The columns that tell documents apart: the id (a null as the least number) and a hash of the row.
KEY, NO_ID = ["id", "mark"], -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """id, mark, n, text."""
    return documents(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("doc_id", "text").alias("mark"), F.length("text").cast("long").alias("n"), "text")


def vectors(pieces: DataFrame, by: list[str]) -> DataFrame:
    """by, equal array<bigint> (modulo 2^32), signs array<int>: the summed vectors of all pieces (sign 1, or -1 to take away; text)."""
    lines = pieces.select(*by, "sign", F.explode(F.split("text", "\n", -1)).alias("line"))
    hashed = lines.select(*by, "sign", "line", F.sha2("line", 256).alias("h"))
    lanes = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"e{k}") for k in range(EQUAL_LANES)]
    phrases = hashed.select(*by, "sign", *lanes, "line").select(*by, "sign", *(f"e{k}" for k in range(EQUAL_LANES)), F.posexplode(F.split("line", PHRASE_END, -1)).alias("at", "phrase"))
    words = SIGN_LANES // 64
    once = [F.when(F.col("at") == 0, F.col("sign") * F.col(f"e{k}")).otherwise(0).alias(f"e{k}") for k in range(EQUAL_LANES)]
    bits = phrases.select(*by, "sign", *once, *(F.xxhash64("phrase", F.lit(w)).alias(f"h{w}") for w in range(words)))
    sums = [F.sum(F.col("sign") * F.shiftright(f"h{w}", k).bitwiseAND(F.lit(TWO_LANES))).alias(f"s{w}_{k}") for w in range(words) for k in range(32)]
    summed = bits.groupBy(*by).agg(F.sum("sign").alias("phrases"), *(F.sum(f"e{k}").alias(f"e{k}") for k in range(EQUAL_LANES)), *sums)

    def wrapped(x: Column) -> Column:  # modulo 2^32 as a signed number
        return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)

    def sign(ones: Column) -> Column:  # ones less zeros
        return wrapped(2 * ones - F.col("phrases")).cast("int")

    places = [(w, k) for w in range(words) for k in range(32)]
    low = [wrapped(F.col(f"s{w}_{k}")) for w, k in places]
    high = [F.shiftright(F.col(f"s{w}_{k}") - x, 32) for (w, k), x in zip(places, low, strict=True)]
    return summed.select(*by, F.array(*(F.pmod(F.col(f"e{k}"), F.lit(1 << 32)) for k in range(EQUAL_LANES))).alias("equal"), F.array(*map(sign, low), *map(sign, high)).alias("signs"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector, modulo 2^32, of two texts together (sign 1), or of the first without the second (-1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x.cast("long") + sign * y.cast("long"), F.lit(1 << 32)))


def signed(a: Column) -> Column:
    """Numbers modulo 2^32 as signed ones."""
    return F.transform(a, lambda x: F.when(x >= 1 << 31, x - F.lit(1 << 32)).otherwise(x).cast("int"))


def text_of(equal: Column, signs: Column) -> Column:
    """The fingerprint in hexadecimal digits."""
    digits = F.transform(signs, lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32))), 8, "0"))
    return F.lower(F.concat(F.array_join(F.transform(equal, lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.array_join(digits, "")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def likeness(same: Column, a: Column, b: Column) -> Column:
    """0 to 1; equal fingerprints are 1."""
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    return F.when(same, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))))


def before(ids: DataFrame) -> DataFrame:
    """KEY, prev (struct of KEY and n): each key's forerunner in a ring. ids: KEY (unique), n.

    Ranges of ids lie in one partition each; only their last ids meet (one row a partition).
    """
    dealt = cut(ids.repartitionByRange(partitions(ids.sparkSession), *KEY).select(*KEY, "n", F.spark_partition_id().alias("part")))
    inside, whole, every = Window.partitionBy("part").orderBy(*KEY), Window.partitionBy(F.lit(0)).orderBy("part"), Window.partitionBy(F.lit(0))
    lasts = dealt.groupBy("part").agg(F.max(F.struct(*KEY, "n")).alias("last"))
    lasts = lasts.select("part", F.coalesce(F.lag("last").over(whole), F.max("last").over(every)).alias("other"))
    near = dealt.select(*KEY, "part", F.lag(F.struct(*KEY, "n")).over(inside).alias("own"))
    return near.join(F.broadcast(lasts), "part").select(*KEY, F.coalesce("own", "other").alias("prev"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document (equal rows give one)."""
    rows = vectors(keyed(docs).select(*KEY, F.lit(1).cast("long").alias("sign"), "text").distinct(), KEY)
    return rows.select(F.nullif("id", F.lit(NO_ID)).cast(docs.schema["doc_id"].dataType).alias("doc_id"), text_of(F.col("equal"), F.col("signs")).alias("fingerprint"))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text (its last quarter replaced by the beginning of the next
    document), and their likeness.

    Whole texts go through one exchange. Their beginnings and vectors follow them to their forerunners, and an edited
    text's vector is the text's own, less its last lines, plus what stands there after the edit.
    """
    ids = keyed(docs).groupBy(*KEY).agg(F.max("n").alias("n"))
    one = Window.partitionBy(*KEY).orderBy("n")
    # both uses of texts read the same columns, so that they share the exchange; a rank would be pushed below it, lag is not
    texts = keyed(docs).withColumns({"copy": F.row_number().over(one), "fresh": F.lag("n").over(one).isNull()}).join(before(ids), KEY)
    first = texts.where("fresh")
    to_prev = [F.col(f"prev.{c}").alias(c) for c in KEY]
    heads = first.select(*to_prev, F.substr("text", F.lit(1), F.floor(F.col("prev.n") / 4).cast("int")).alias("head"))
    plus = F.lit(1).cast("long")
    own = vectors(first.select(*KEY, "prev", plus.alias("sign"), "text"), [*KEY, "prev"]).repartition(*KEY)
    after = own.select(*to_prev, F.col("equal").alias("next_equal"), F.col("signs").alias("next_signs"))
    keep = (F.col("n") - F.floor(F.col("n") / 4)).cast("int")
    both = texts.join(heads, KEY).withColumn("kept", F.substr("text", F.lit(1), keep))
    stub = F.substring_index("kept", "\n", -1)  # what is left of the line that the edit cuts
    old, new = F.substr("text", keep - F.length(stub) + 1), F.concat(stub, "head")
    pieces = F.array(F.struct((-plus).alias("sign"), old.alias("text")), F.struct(plus.alias("sign"), new.alias("text")))
    by = [*KEY, "copy", "n", "edited_sha256"]
    changed = both.select(*KEY, "copy", "n", F.sha2(F.concat("kept", "head"), 256).alias("edited_sha256"), F.explode(pieces).alias("piece"))
    change = vectors(changed.select(*by, "piece.sign", "piece.text"), by).select(*by, F.col("equal").alias("d_equal"), F.col("signs").alias("d_signs"))
    rows = change.join(own.select(*KEY, "equal", "signs"), KEY).join(after, KEY)
    rows = rows.select("*", combine(F.col("equal"), F.col("d_equal")).alias("new_equal"), signed(combine(F.col("signs"), F.col("d_signs"))).alias("new_signs"))
    same = lambda kind: (F.col("equal") == F.col(f"{kind}_equal")) & (F.col("signs") == F.col(f"{kind}_signs"))
    return rows.select(
        F.nullif("id", F.lit(NO_ID)).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256",
        text_of(F.col("equal"), F.col("signs")).alias("fingerprint"),
        text_of(F.col("new_equal"), F.col("new_signs")).alias("edited_fingerprint"),
        likeness(same("new"), F.col("signs"), F.col("new_signs")).alias("near_edited"),
        likeness(same("next"), F.col("signs"), F.col("next_signs")).alias("near_next"),
    )
