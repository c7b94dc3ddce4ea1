"""Line dedup by a log-template tree of fixed depth, in DataFrame operations only.

The tree has a level for the number of tokens and one for each of the first LEADING tokens; tokens with a digit count as the wildcard. Lines with the same path share a leaf. In a leaf, a token at a later position is kept where at least MIN_DOCS lines of documents have it there, and becomes the wildcard where not; what is left is the line's template. Lines whose template recurs in at least MIN_DOCS documents, with at least CONSTANT of its tokens kept, are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import kept_table, lookup

MIN_DOCS, LEADING, CONSTANT = 5, 3, 0.6
WILD = "<*>"

_WHITE = r"[\x20\x09-\x0D]+"
_DIGITS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def spaced(line: Column) -> Column:
    """The line's tokens with one space between them. Most lines are so already, which plain searches tell for less than a pattern."""
    odd = F.contains(line, F.lit("  "))
    for white in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(white))
    return F.trim(F.when(odd, F.regexp_replace(line, _WHITE, " ")).otherwise(line))


def masked(tokens: Column) -> Column:
    """Tokens with a digit as the wildcard."""
    return F.when(tokens.rlike("[0-9]"), F.regexp_replace(tokens, _DIGITS, F.lit(WILD))).otherwise(tokens)


def lines(docs: DataFrame, doc_id: str, text: str, leading: int = LEADING) -> DataFrame:
    """doc (a hash of identifier and text), at, tokens and leaf for each line of each row that has a token."""
    body = F.coalesce(F.col(text), F.lit(""))
    each = F.transform(F.split(body, "\n", -1), lambda line, at: F.struct(at.alias("at"), spaced(line).alias("tokens")))
    rows = docs.select(_key(F.col(doc_id), body).alias("doc"), F.inline(each)).where("tokens != ''")
    return rows.withColumn("leaf", leaf("tokens", leading))


def _key(doc_id: Column, body: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), doc_id.isNull(), body)


def leaf(tokens: str = "tokens", leading: int = LEADING) -> Column:
    """The path of a line in the tree, hashed: its number of tokens and the first ones, masked."""
    n = F.octet_length(tokens) - F.octet_length(F.replace(F.col(tokens), F.lit(" "), F.lit(""))) + 1
    return F.xxhash64(n, masked(F.substring_index(tokens, " ", leading)))


def templates(seen: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, constant: float = CONSTANT) -> DataFrame:
    """line and template (hashes) of the distinct lines (line, masked, leaf, n_docs) with enough tokens kept."""
    tokens = seen.select("leaf", "line", "n_docs", F.posexplode(F.split("masked", " ", -1)).alias("at", "token"))
    fixed = tokens.groupBy("leaf", "at", "token").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= min_docs).select("leaf", "at", "token", F.lit(True).alias("often"))
    kept = (F.col("token") != WILD) & ((F.col("at") < leading) | F.col("often").isNotNull())
    found = tokens.join(fixed, ["leaf", "at", "token"], "left").groupBy("leaf", "line").agg(F.avg(kept.cast("double")).alias("share"), F.bit_xor(F.when(kept, F.xxhash64("at", "token")).otherwise(F.lit(0))).alias("form"))
    return found.where(F.col("share") >= constant).select("line", F.xxhash64("leaf", "form").alias("template"))


def dropped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """doc and at of every line to drop."""
    every = lines(docs, doc_id, text)
    full = kept_table(every.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "leaves")
    # few of all lines share a leaf with enough others: from here on, only those are kept
    shared = every.join(full, "leaf").select("doc", "at", "leaf", masked(F.col("tokens")).alias("masked"))
    placed = kept_table(shared.withColumn("line", F.xxhash64("masked", "leaf")), "lines")
    per_doc = placed.select("doc", "line").distinct()
    counts = per_doc.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"))
    texts = placed.groupBy("line").agg(F.first("masked").alias("masked"), F.first("leaf").alias("leaf"), F.count(F.lit(1)).alias("n_lines"))
    seen = kept_table(texts.join(counts, "line"), "seen")
    formed = kept_table(templates(seen, min_docs), "templates")
    total = placed.count()
    sized = formed.join(seen.select("line", "n_lines"), "line")
    recurring = lookup(per_doc, sized, ["line"], "n_lines", total).select("template", "doc").distinct().groupBy("template").count().where(F.col("count") >= min_docs).select("template")
    gone = kept_table(sized.join(recurring, "template").select("line", "n_lines"), "recurring")
    return lookup(placed.select("doc", "at", "line"), gone, ["line"], "n_lines", total).select("doc", "at")


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (what is left, lines joined by a line feed) for each row of docs.

    A null text counts as empty, which is one line without tokens; such lines always stay. Rows that agree in doc_id and text count as one document, and are answered each. Ties don't arise. Other columns of docs play no part, whatever their names. An empty table gives no rows.
    """
    gone = kept_table(dropped(docs, doc_id, text, min_docs).groupBy("doc").agg(F.collect_list("at").alias("gone")), "gone")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), _key(F.col(doc_id), body).alias("doc"))
    joined = rows.join(gone.hint("shuffle_hash"), "doc", "left").withColumn("all", F.split("text", "\n", -1))
    stays = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda i: F.get(F.col("all"), i)), "\n"))
    return joined.select("doc_id", F.size("all").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"), left.alias("text"))
