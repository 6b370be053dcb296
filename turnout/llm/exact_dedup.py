"""Exact dedup by content-defined chunk recipes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import SPACE, apart, field, identity, numbered, packed, stored, text_or_empty

# A text is cut into atoms at the characters of one class, and atoms are joined to chunks that end
# where the hash of an atom says so, one time in ATOMS_A_CHUNK. An atom alone decides about its end,
# so equal passages are cut alike wherever they stand in a text. Atoms have some 13 characters in
# languages of Latin letters, chunks some 800.
ATOM_CHARS, ATOMS_A_CHUNK = 64, 64
# Every 16th character below 256, and frequent ones of other scripts; few, as each is a test per character.
ATOM_END = "".join(rf"\x{code:02x}" for code in range(0x22, 0x100, 16)) + r"\u043e\u03b1\u0627\u093e\u4e00-\u513f"
ATOM = rf"(?s)[^{ATOM_END}]{{0,{ATOM_CHARS - 1}}}[{ATOM_END}]|.{{1,{ATOM_CHARS}}}"


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, text_sha256, chunks) per row of ``docs``.

    ``chunks`` lists the text without white space as (id, check, length): the chunk's SHA-256, an
    independent 64-bit hash and its length. The long text itself is read here and moved nowhere.
    A null text is empty and has no chunk. Further columns are ignored.
    """
    texts = packed(docs).select(field("doc_id").alias("doc_id"), text_or_empty().alias("text"))
    normal = texts.select(
        "doc_id",
        F.length("text").cast("long").alias("n_points"),
        F.regexp_replace("text", SPACE, "").alias("normal"),
    )
    atoms = normal.select(
        "doc_id",
        "n_points",
        F.sha2("normal", 256).alias("text_sha256"),
        F.regexp_extract_all("normal", F.lit(ATOM), F.lit(0)).alias("atoms"),
    )
    n_atoms = F.size("atoms")

    def is_end(i: Column) -> Column:
        return (i == n_atoms) | (F.pmod(F.xxhash64(F.element_at("atoms", i)), F.lit(ATOMS_A_CHUNK)) == 0)

    ends = atoms.select(
        "*",
        F.when(n_atoms > 0, F.filter(F.sequence(F.lit(1), n_atoms), is_end))
        .otherwise(F.array().cast("array<int>"))
        .alias("ends"),
    )

    def chunk(end: Column, k: Column) -> Column:
        before = F.when(k == 0, 0).otherwise(F.element_at("ends", F.greatest(k, F.lit(1))))
        return F.array_join(F.slice("atoms", before + 1, end - before), "")

    return ends.select("doc_id", "n_points", "text_sha256", F.transform("ends", chunk).alias("chunks")).select(
        "doc_id",
        "n_points",
        "text_sha256",
        F.transform(
            "chunks",
            lambda c: F.struct(
                F.unhex(F.sha2(c, 256)).alias("id"),
                F.xxhash64(c).alias("check"),
                F.length(c).alias("length"),
            ),
        ).alias("chunks"),
    )


def chunk_dictionary(recipe_table: DataFrame) -> DataFrame:
    """(id, uses, verified) per distinct chunk; an id is verified if hash and length agree in all its uses."""
    used = recipe_table.select(F.explode("chunks").alias("c")).select("c.*")
    return (
        used.groupBy("id")
        .agg(
            F.count("*").alias("uses"),
            F.min("check").alias("low"),
            F.max("check").alias("high"),
            F.min("length").alias("short"),
            F.max("length").alias("long"),
        )
        .select("id", "uses", ((F.col("low") == F.col("high")) & (F.col("short") == F.col("long"))).alias("verified"))
    )


def recipe_of(chunks: Column) -> Column:
    """The digest of the ordered list of verified identifiers: of each chunk the id, check and length.

    Two chunks that share an id but not its verification are different here, so a collision parts
    texts instead of joining them. A text without chunks has the digest of nothing.
    """
    names = F.transform(
        chunks, lambda c: F.concat_ws(":", F.hex(c["id"]), c["check"].cast("string"), c["length"].cast("string"))
    )
    return F.unhex(F.sha2(F.array_join(names, ","), 256))


def find_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal if they are identical without white space, which is if their recipes are equal. The
    row with the most code points stays, then the smallest doc_id, a null one last. Null and empty texts
    are one group. Rows that repeat a doc_id within a group are the same document: they share its
    decision. An empty table gives no row.

    Recipes, not texts, are grouped and joined. A group of any size is combined before the shuffle,
    and only groups of two or more are joined back, by a join that adaptive execution can split.
    """
    table = stored(
        recipes(docs).select("doc_id", "n_points", "text_sha256", recipe_of(F.col("chunks")).alias("recipe")), "recipes"
    )
    order = F.struct(
        (-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("last"), F.col("doc_id")
    )
    groups = (
        table.select("recipe", order.alias("best"))
        .groupBy("recipe")
        .agg(F.min("best").alias("best"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("recipe").alias("key"), F.col("best.doc_id").alias("best_id"), "n")
    )
    joined = table.join(apart(groups), F.col("recipe") == F.col("key"), "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a numbered table whose row_id is not in ``dropped``, with all the caller's columns."""
    gone = dropped.select(F.col("row_id").alias("gone_id"))
    return rows.join(apart(gone), F.col("row_id") == F.col("gone_id"), "left_anti").select("row.*")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with exactly one row of each group of equal texts.

    Rows are decided about one by one, by numbers stored with them: a doc_id may be null, and may be
    repeated with equal or other texts. The row that stays is the one with the most code points, then
    the smallest doc_id, a null one last, then one by a hash of the row.
    """
    rows = numbered(docs)
    found = find_duplicates(rows.select(identity(rows).alias("doc_id"), field("text").alias("text")))
    return without(rows, found.where("not kept").select("doc_id.row_id"))
