"""Duplicates hidden by formatting: records equal but for white space, case, punctuation or layout.

Method: dictionary encoding. Each distinct raw value of a field is canonicalised once and gets the
integer of its canonical value; a record becomes the tuple of its integers in the order of the fields;
the compact tuples are grouped.

The integer of a canonical value is a 128-bit hash of it, held as two longs: it needs no numbering of
all values, does not change when a task runs again, and two values of a hundred billion share one with a
chance below 1e-16.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import fold
from quillgraph.llm.blocks import pairs_within
from quillgraph.session import cut

#: A raw value of this share of the rows is hot, so there are at most 1 / HOT of them.
HOT = 1 / 2000

# Titles that name no work, without case, white space and punctuation.
PLACEHOLDERS = (
    "na none null nil nan tbd tba todo xxx unknown untitled notitle titleunknown unknowntitle titlenotavailable "
    "notavailable titleunavailable titlemissing missingtitle missing noname unnamed undefined unspecified notitlegiven "
    "untitleddocument sanstitre titreinconnu inconnu ohnetitel unbekannt titelunbekannt keintitel keinenangabe "
    "sintítulo sintitulo títulodesconocido desconocido semtítulo semtitulo desconhecido senzatitolo sconosciuto "
    "zondertitel geentitel onbekend безназвания неизвестно нетназвания 無題 タイトルなし 題名なし 不明 无标题 無標題 未知 无题"
).split()


def names_no_work(canonical: Column) -> Column:
    """True for a folded title that is missing, blank or a placeholder."""
    return F.coalesce((canonical == "") | canonical.isin(*PLACEHOLDERS), F.lit(True))


def _integer(value: Column) -> tuple[Column, Column]:
    """The two halves of the 128-bit integer of a text."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def encode(
    df: DataFrame,
    id_column: str,
    fields: dict[str, Callable[[Column], Column]],
    numbers: Sequence[str] = (),
    absent: Callable[[Column], Column] = lambda form: form == "",
) -> DataFrame:
    """(id, key): each record as a tuple of integers, two per text field, NULL where the field is absent.

    ``fields`` names string columns and gives how a value of each is canonicalised; ``numbers`` names
    integer columns, which are their own codes. A field is absent where it is NULL or ``absent`` holds
    for its canonical form, so absent, null and empty are the same. Each distinct raw value is
    canonicalised once, in full, however long: in the dictionary, which stays where its distinct values
    were brought together, and to which only the rows are shuffled. Hot raw values, at most 1 / HOT by
    their counts, are looked up in a broadcast of fixed width, and rows with one, or with NULL, are
    spread evenly. Repeated rows come out as often as they occur; an empty table gives an empty result;
    further columns are ignored.
    """
    out = df.select(
        F.col(id_column).alias("id"),
        *[F.col(c).alias(f"_raw{i}") for i, c in enumerate(fields)],
        *[F.col(c).cast("long").alias(f"_n{i}") for i, c in enumerate(numbers)],
    )
    for i, (name, canonicalise) in enumerate(fields.items()):
        raw, v, w = f"_raw{i}", f"_v{i}", f"_w{i}"
        values = df.select(F.col(name).alias("_key")).where(F.col("_key").isNotNull())
        counted = values.groupBy("_key").agg(F.count(F.lit(1)).alias("_times"))
        forms = counted.withColumn("_form", canonicalise(F.col("_key")))
        high, low = (F.when(~absent(F.col("_form")), half) for half in _integer(F.col("_form")))
        dictionary = forms.select("_key", "_times", high.alias(v), low.alias(w))
        every = counted.agg(F.sum("_times")).scalar()
        by_hash = [x.alias(n) for n, x in zip(("_x", "_y"), _integer(F.col("_key")))]
        hot = dictionary.where(F.col("_times") >= F.lit(HOT) * every).select(
            *by_hash,
            F.col(v).alias("_hot_v"),
            F.col(w).alias("_hot_w"),
            F.lit(True).alias("_hot"),
        )
        marked = out.withColumns(dict(zip(("_x", "_y"), _integer(F.col(raw)))))
        marked = marked.join(F.broadcast(hot), ["_x", "_y"], "left")  # four longs each, at most 1 / HOT
        # Rows that need no look-up get keys of their own; one that happens to be a raw value is not used.
        needed = F.col(raw).isNotNull() & F.col("_hot").isNull()
        elsewhere = F.concat(F.lit("\0"), F.hex(F.xxhash64("id", *[F.col(c) for c in out.columns if c not in ("id", raw)])))
        marked = marked.withColumn("_key", F.when(needed, F.col(raw)).otherwise(elsewhere))
        rest = [c for c in out.columns if c != raw]
        found = marked.select(*rest, "_key", "_hot", "_hot_v", "_hot_w", F.col(raw).isNull().alias("_none")).join(
            dictionary.drop("_times"),
            "_key",
            "left",
        )
        pick = lambda own, hot: F.when(F.col("_hot"), F.col(hot)).when(~F.col("_none"), F.col(own)).alias(own)
        out = found.select(*rest, pick(v, "_hot_v"), pick(w, "_hot_w"))
    values = [f"{x}{i}" for i in range(len(fields)) for x in ("_v", "_w")] + [f"_n{i}" for i in range(len(numbers))]
    return out.select("id", F.struct(*values).alias("key"))


def collapse(encoded: DataFrame) -> DataFrame:
    """(id, copies): one row per different record: its smallest id and the number of its copies.

    A row stored twice under one id is one record. Rows with a NULL id form records as well; their id
    is NULL if no other copy has one.
    """
    return encoded.distinct().groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).drop("key")


def copies(encoded: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two records that are equal. Rows with a NULL id have no pair.

    A row that is stored twice under one id is one record. Large groups are paired in blocks.
    """
    members = cut(encoded.where(F.col("id").isNotNull()))  # counted, then paired
    return pairs_within(members, "key", "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


# --- papers -----------------------------------------------------------------------------------


def encoded_papers(paper: DataFrame) -> DataFrame:
    """Papers by folded title and publication year. Papers without a title that names a work are left
    out; a missing year equals a missing year."""
    titled = paper.where(F.col("title").isNotNull())
    encoded = encode(titled, "id", {"title": fold}, ["publication_year"], names_no_work)
    return encoded.where(F.col("key._v0").isNotNull())


# --- raw records ------------------------------------------------------------------------------

#: The fields of a metadata record.
FIELDS = ("display_name", "publication_year", "venue")
_NAME = r"(?:" + "|".join(f.replace("_", r"[\s_-]*") for f in FIELDS) + ")"


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[\s_-]+", "")


def parse_records(raw: DataFrame, id_column: str = "record_id", payload: str = "payload") -> DataFrame:
    """(id, readable, display_name, publication_year, venue) of raw records; other columns are ignored.

    A payload is a JSON object, or a list of ``name=value`` / ``name: value`` separated by ``;``,
    ``|``, tabs or line breaks. Names are compared without case, white space, ``_`` and ``-``. A
    separator counts only where the name of a field follows, so values may hold one. ``readable`` is
    false, and the fields are NULL, where a payload cannot be read: NULL, blank, JSON that does not
    close, or a list with fewer than two of the fields (one that was cut off within its first value).
    """
    text = F.col(payload)
    names = [f.replace("_", "") for f in FIELDS]
    parsed = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE", "allowNumericLeadingZeros": "true"})
    from_json = F.filter(
        F.transform(
            F.map_entries(parsed),
            lambda e: F.struct(_bare(e["key"]).alias("name"), e["value"].alias("value")),
        ),
        lambda e: e["name"].isin(*names),
    )
    pieces = F.split(text, rf"(?i)[;|\t\r\n]+\s*(?={_NAME}\s*[:=])")
    shape = rf"(?is)\A\s*({_NAME})\s*[:=](.*)\z"
    from_list = F.transform(
        F.filter(pieces, lambda p: p.rlike(shape)),
        lambda p: F.struct(
            _bare(F.regexp_extract(p, shape, 1)).alias("name"),
            F.regexp_extract(p, shape, 2).alias("value"),
        ),
    )
    closed = text.rlike(r"(?s)\A\s*\{.*\}\s*\z")
    entries = (
        F.when(text.rlike(r"\A\s*\{"), F.when(closed & parsed.isNotNull(), from_json))
        .when(F.size(from_list) >= 2, from_list)
    )
    rows = raw.select(id_column, entries.alias("_entries"))
    # The last of two equal names wins, as in most readers of JSON; no such name gives NULL.
    value = lambda n: F.try_element_at(F.filter("_entries", lambda e: e["name"] == n), F.lit(-1))["value"]
    out = [value(n).alias(f) for n, f in zip(names, FIELDS)]
    return rows.select(id_column, F.col("_entries").isNotNull().alias("readable"), *out)


def encoded_records(raw: DataFrame) -> DataFrame:
    """Readable raw records by their three folded fields. A number and its digits are the same year."""
    rows = cut(parse_records(raw).where("readable"))  # parsed once, read by each field's dictionary
    year = lambda c: F.regexp_replace(fold(F.regexp_replace(c, r"\.0+\s*\z", "")), r"\A0+(?=\d)", "")
    return encode(rows, "record_id", {"display_name": fold, "publication_year": year, "venue": fold})


def found(paper: DataFrame, raw: DataFrame) -> DataFrame:
    """(rel, id_a, id_b): equal rows of ``paper`` and equal records of ``raw``."""
    kinds: Sequence[tuple[str, DataFrame]] = (("paper", encoded_papers(paper)), ("raw_record", encoded_records(raw)))
    one, two = (copies(e).select(F.lit(rel).alias("rel"), "id_a", "id_b") for rel, e in kinds)
    return one.unionByName(two)
