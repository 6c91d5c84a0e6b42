"""Records that differ only in formatting, by bottom-up hashing of their structure.

A leaf is its letters, marks and digits in lower case. A list is the digest of its children's digests in order; a
struct, a map, a list named as unordered, and a text made of fields are the digest of their children's *sorted*
digests, so the order of fields doesn't matter. Records with equal root digests are candidates, and a comparison of
the full canonical forms confirms them: of each digest that several records have, the least and the greatest form are
aggregated, which combines copies before they travel, and must be equal; records of a digest where they aren't are
grouped by the forms themselves. All else is counted over ids and digests only, and what a group is told reaches its
rows without moving those of heavy groups, so a group may hold a third of all rows.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.operators.relational import spread_lookup
from gavel.sources.staging import stage

#: What separates two fields, and what a field looks like (a name of at most 60 characters, a colon, a value).
FIELD_BREAK = "[;|\\r\\n]+"
FIELD = "^\\s*[^:]{0,59}\\p{L}[^:]{0,59}:(?s:.*)[\\p{L}\\p{Nd}]"
OPENING = "^[^:;|\\r\\n]{1,120}:"
#: White space between words, as Unicode has it.
WHITE = "[\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def leaf(text: Column) -> Column:
    """The letters, marks and digits of a text, in order, in lower case."""
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}\\p{Nd}]+", "")


def fields_of(text: Column) -> Column:
    """The fields of a text that is made of two or more `name: value` fields; null for any other text."""
    parts = F.filter(F.split(text, FIELD_BREAK), lambda p: F.length(leaf(p)) > 0)
    made = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(FIELD))
    return F.when(text.rlike(OPENING) & made, F.array_sort(F.array_distinct(F.transform(parts, leaf))))


def canonical(column: Column, kind: T.DataType, unordered: Collection[str] = (), path: str = "") -> Column:
    """The full canonical form of a value as a string; equal for values that are the same but for formatting.

    Every node is written with its kind and the lengths of its children, so different structures never collide. Null
    and absent values are written as such, and differ from empty text.
    """
    bare = lambda s: F.concat(F.length(s).cast("string"), F.lit(":"), s)
    if isinstance(kind, T.StringType):
        body = F.coalesce(F.concat(F.lit("F"), F.array_join(F.transform(fields_of(column), bare), "")), F.concat(F.lit("T"), leaf(column)))
    elif isinstance(kind, T.StructType):
        parts = [
            F.concat(bare(F.lit(f.name.lower())), bare(canonical(column.getField(f.name), f.dataType, unordered, f"{path}.{f.name}")))
            for f in kind.fields
        ]
        body = F.concat(F.lit("S"), F.array_join(F.array_sort(F.array(*parts)), ""))
    elif isinstance(kind, T.ArrayType):
        parts = F.transform(column, lambda x: bare(canonical(x, kind.elementType, unordered, f"{path}[]")))
        body = F.concat(F.lit("L"), F.array_join(F.array_sort(parts) if path.lstrip(".") in unordered else parts, ""))
    elif isinstance(kind, T.MapType):
        parts = F.transform(
            F.map_entries(column),
            lambda e: F.concat(bare(canonical(e["key"], kind.keyType)), bare(canonical(e["value"], kind.valueType, unordered, f"{path}{{}}"))),
        )
        body = F.concat(F.lit("M"), F.array_join(F.array_sort(parts), ""))
    else:
        body = F.concat(F.lit("V"), column.cast("string"))
    return F.coalesce(body, F.lit("N"))


def digest(column: Column, kind: T.DataType, unordered: Collection[str] = (), path: str = "", ready: bool = False) -> Column:
    """The root digest of a value, bottom-up: 32 hexadecimal digits. With `ready`, texts are leaves in normal form already."""
    if isinstance(kind, T.StringType):
        fields = F.concat(F.lit("F"), F.array_join(F.array_sort(F.transform(fields_of(column), F.md5)), ""))
        body = F.concat(F.lit("T"), column) if ready else F.coalesce(fields, F.concat(F.lit("T"), leaf(column)))
    elif isinstance(kind, T.StructType):
        parts = [
            F.md5(F.concat(F.lit(f"{f.name.lower()}="), digest(column.getField(f.name), f.dataType, unordered, f"{path}.{f.name}", ready)))
            for f in kind.fields
        ]
        body = F.concat(F.lit("S"), F.array_join(F.array_sort(F.array(*parts)), ""))
    elif isinstance(kind, T.ArrayType):
        parts = F.transform(column, lambda x: digest(x, kind.elementType, unordered, f"{path}[]", ready))
        body = F.concat(F.lit("L"), F.array_join(F.array_sort(parts) if path.lstrip(".") in unordered else parts, ""))
    elif isinstance(kind, T.MapType):
        parts = F.transform(
            F.map_entries(column),
            lambda e: F.md5(F.concat(digest(e["key"], kind.keyType, ready=ready), digest(e["value"], kind.valueType, unordered, f"{path}{{}}", ready))),
        )
        body = F.concat(F.lit("M"), F.array_join(F.array_sort(parts), ""))
    else:
        body = F.concat(F.lit("V"), column.cast("string"))
    return F.md5(F.coalesce(body, F.lit("N")))


def collapse(records: DataFrame, id_col: str, columns: list[str], unordered: Collection[str] = ()) -> DataFrame:
    """Every record with the smallest id of its group and the group's size: `id_col`, `first_id`, `copies`.

    Records are equal if all `columns` are. Ids needn't be unique; a null id is larger than any other. Records without
    copies have themselves as first and `copies` 1.
    """
    struct = T.StructType([records.schema[c] for c in columns])
    value = F.struct(*columns)
    rows = records.select(F.col(id_col).alias("_id"), F.unhex(digest(value, struct, unordered)).alias("_root"), canonical(value, struct, unordered).alias("_form"))
    rows = confirmed(stage(rows, "forms"), "_root", "_form").select("_id", "_root")
    return grouped(rows, 1).withColumnRenamed("_id", id_col)


def confirmed(rows: DataFrame, key: str, form: str) -> DataFrame:
    """`rows` with `key` replaced by the whole form where records of one digest have several forms. Null keys stay.

    rows: a staged table. Forms travel only of digests that several records have, and copies of them are combined first.
    """
    several = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    forms = rows.join(several, key, "left_semi").groupBy(key).agg(F.min(form).alias("_least"), F.max(form).alias("_most"))
    wrong = stage(forms.where("_least <> _most").select(key, F.lit(True).alias("_wrong")), "collisions")
    if wrong.isEmpty():
        return rows
    marked = rows.join(wrong, key, "left")
    return marked.withColumn(key, F.when(F.col("_wrong"), F.encode(F.concat(F.lit("="), F.col(form)), "utf-8")).otherwise(F.col(key))).drop("_wrong")


def grouped(rows: DataFrame, least: int) -> DataFrame:
    """`_id`, `first_id`, `copies` of the rows (`_id`, `_root`) whose group has `least` rows or more."""
    roots = rows.groupBy("_root").agg(F.min("_id").alias("first_id"), F.count("*").alias("copies")).where(F.col("copies") >= least)
    return spread_lookup(rows, roots, "_root", "copies").select("_id", "first_id", "copies")


def same_texts(df: DataFrame, id_col: str, text_col: str, least_words: int = 25) -> DataFrame:
    """`id_col`, `first_id`, `copies` of each text of `least_words` or more words that occurs more than once.

    Texts are the same when their letters, marks and digits are, in order; and a text of fields is also the same as one
    with the same set of fields in any order. Both hold at once: a text that is written without field breaks joins the
    group of the field texts with the same letters (of several such groups, that of the smallest digest). Null, empty
    and shorter texts take no part.
    """
    text = F.col(text_col)
    words = F.size(F.split(F.regexp_replace(text, f"^{WHITE}|{WHITE}$", ""), WHITE))
    # Each step is made behind a generator, so that the optimizer doesn't repeat it wherever it is used.
    once = lambda c: F.explode(F.array(c))
    rows = df.where(text.isNotNull() & (words >= least_words)).select(F.col(id_col).alias("_id"), text.alias("_text"), once(leaf(text)).alias("_letters"))
    may = F.col("_text").rlike(OPENING)
    rows = rows.select("_id", "_letters", once(F.when(may, F.filter(F.split("_text", FIELD_BREAK), lambda p: F.length(leaf(p)) > 0))).alias("_parts"))
    made = F.col("_parts").isNotNull() & (F.size("_parts") >= 2) & F.forall("_parts", lambda p: p.rlike(FIELD))
    # A text of fields is a node with its fields as children, in no order; any other text is a leaf.
    rows = rows.select("_id", "_letters", once(F.when(made, F.array_sort(F.array_distinct(F.transform("_parts", leaf))))).alias("_fields"))
    node = T.ArrayType(T.StringType())
    rows = rows.select(
        "_id",
        F.unhex(digest(F.col("_letters"), T.StringType(), ready=True)).alias("_flat"),
        "_letters",
        F.when(F.col("_fields").isNotNull(), F.unhex(digest(F.col("_fields"), node, [""], ready=True))).alias("_set"),
        F.array_join("_fields", "\n").alias("_form"),
    )
    # The normal forms are made once; what follows reads columns of them.
    forms = stage(rows, "forms")
    flat = confirmed(forms, "_flat", "_letters")
    rows = confirmed(flat if flat is forms else stage(flat, "forms"), "_set", "_form").select("_id", "_flat", "_set")
    # Flat digests of field texts lead to the digest of their fields.
    led = rows.where("_set is not null").groupBy("_flat").agg(F.min("_set").alias("_to"))
    rows = rows.join(led, "_flat", "left").select("_id", F.coalesce("_to", "_flat").alias("_root"))
    return grouped(rows, 2).withColumnRenamed("_id", id_col)
