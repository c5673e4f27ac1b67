"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

1. A pass over the texts finds matches of several kinds and writes, for each, how far it lies from the match before, its
   length and a hash of its value to the shared folder; values themselves are never written, and texts of documents
   without a match never shuffle. Each regular expression runs once a text, whatever the number of matches.
2. Matches become rows; a running sum over those of one text and kind gives their places in code points.
3. Hashes are counted by distinct owners and repositories: rows are grouped by (hash, owner, repository), then (hash,
   owner), then hash, so sums combine before each shuffle. What MANY_OWNERS owners or MANY_REPOSITORIES repositories
   hold, or what spells a placeholder, is a widely copied example; any other value is owner-specific and looks live.
   Values are compared in lower case, as keys are written either way. Hashes that many rows hold, few by definition, are
   broadcast to their rows, the others meet by a shuffle.
4. Base kinds (assign, access, hex) are always reported; further kinds (known, upper, random) only where they look live.

Nulls and edge cases: a null text is empty; a null owner or repository counts as one of its own; a null doc_id passes
through; repeated rows are scanned one by one and count as one owner; ties in start go by kind as listed; a text with very
many matches takes time and memory in proportion to them; an empty table gives an empty result; further columns pass
through secret_scan where it is told to keep them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, hot_join, materialise, table

#: (kind, pattern, group of the value, least length of the value, patterns that the value must hold). Base patterns are fixed values. `{12,}` and `{32,}`
#: find what `+` finds with the length asked for afterwards: runs are as long as they can be, and a run that fails
#: holds no longer one.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ()),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16, ()),
    ("hex", r"[0-9a-f]{32,}", 0, 32, ()),
)
MORE = (
    ("known", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 16, ()),
    ("upper", r"[0-9A-F]{32,}", 0, 32, ("[0-9]", "[A-F]")),
    ("random", r"[A-Za-z0-9+/_-]{40,}", 0, 40, ("[0-9]", "[A-Z]", "[a-z]")),
)
MANY_OWNERS, MANY_REPOSITORIES = 3, 6
PLACEHOLDER = "(?i)example|sample|placeholder|changeme|your[_-]|xxxx|1234567|abcdefg"


SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def found_matches(text: Column, rank: int, pattern: str, group: int, least: int, musts: tuple[str, ...]) -> Column:
    """array<struct<rank, k, gap, size, hash, good, placeholder>> of one kind's matches, in order: code points between it and the
    match before, its own, the hash of its value, and whether it is long enough and holds what it must."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def facts(z: Column, k: Column) -> Column:
        value = z["values"]
        good = F.length(value) >= least
        for must in musts:
            good &= F.rlike(value, F.lit(must))
        return F.struct(F.lit(rank).alias("rank"), k.alias("k"), F.length(z["gaps"]).alias("gap"), F.length(z["whole"]).alias("size"), F.xxhash64(F.lower(value)).alias("hash"), good.alias("good"), is_placeholder(value).alias("placeholder"))

    zipped = F.arrays_zip(F.split(text, pattern).alias("gaps"), whole.alias("whole"), values.alias("values"))
    matches = F.filter(F.transform(zipped, facts), lambda m: m["size"].isNotNull())  # after the last gap there is none
    return F.when(F.rlike(text, F.lit(pattern)), matches).otherwise(F.array().cast("array<struct<rank:int,k:int,gap:int,size:int,hash:bigint,good:boolean,placeholder:boolean>>"))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def is_placeholder(value: Column) -> Column:
    """A word of examples, or one character over and over."""
    return F.rlike(value, F.lit(PLACEHOLDER)) | (F.replace(value, F.substring(value, 1, 1), F.lit("")) == "")


def ownership(values: DataFrame) -> DataFrame:
    """(hash, owners, repositories, rows) of rows (hash, owner, repository)."""
    by_repository = values.groupBy("hash", "owner", "repository").agg(F.count("*").alias("rows"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("rows").alias("rows"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("rows").alias("rows"))


def secret_scan(docs: DataFrame, text_col: str = "text", owner: Column | None = None, repository: Column | None = None, keep: list[str] | None = None, many_owners: int = MANY_OWNERS, many_repositories: int = MANY_REPOSITORIES) -> DataFrame:
    """The columns to keep (all), with base_spans and secret_spans, arrays of struct<start, rank, kind, end>, and n_live and
    n_example, how many of all candidates look live or widely copied. owner defaults to column source, repository to owner
    and lang."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", owner, F.col("lang")) if repository is None else repository
    keep = docs.columns if keep is None else keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = {c: free_name(docs, c) for c in ("base_spans", "secret_spans", "n_live", "n_example", "matches", "row", "owner_", "repository_")}
    row = names["row"]
    kinds = BASE + MORE
    found = docs.select(
        *keep,
        F.monotonically_increasing_id().alias(row),
        F.coalesce(owner.cast("string"), F.lit("")).alias(names["owner_"]),
        F.coalesce(repository.cast("string"), F.lit("")).alias(names["repository_"]),
        F.concat(*[found_matches(text, i, p, g, n, musts) for i, (_, p, g, n, musts) in enumerate(kinds)]).alias(names["matches"]),
    )
    found = materialise(found, "secret-candidates")
    each = found.where(F.size(names["matches"]) > 0).select(F.col(row).alias("row"), F.col(names["owner_"]).alias("owner"), F.col(names["repository_"]).alias("repository"), F.inline(names["matches"]))
    before = Window.partitionBy("row", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(before).cast("int")
    each = each.withColumn("end", end).where("good").select("row", "owner", "repository", "hash", "placeholder", "rank", (F.col("end") - F.col("size")).alias("start"), "end")
    each = materialise(each, "secret-spans")
    owned = ownership(each)
    copied = (F.col("owners") >= many_owners) | (F.col("repositories") >= many_repositories)
    common = materialise(owned.where(copied).select("hash", "rows", F.lit(True).alias("copied")), "copied-values")
    judged = hot_join(each, common, "hash", "rows", each.count(), "left").withColumn("example", F.coalesce("copied", F.lit(False)) | F.col("placeholder"))
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in kinds]), F.col("rank") + 1)
    span = F.struct("start", "rank", kind.alias("kind"), "end")
    base, more = F.col("rank") < len(BASE), ~F.col("example")
    gathered = lambda wanted: F.array_sort(F.collect_list(F.when(wanted, span)))
    of_row = judged.groupBy("row").agg(
        gathered(base).alias(names["base_spans"]),
        gathered(base | more).alias(names["secret_spans"]),
        F.sum((~F.col("example")).cast("long")).alias(names["n_live"]),
        F.sum(F.col("example").cast("long")).alias(names["n_example"]),
    )
    none = F.array().cast(SPANS)
    new = ("base_spans", "secret_spans", "n_live", "n_example")
    result = lambda rows: rows.select(*keep, *[F.coalesce(names[c], none if i < 2 else F.lit(0)).alias(names[c]) for i, c in enumerate(new)])
    held = found.where(F.size(names["matches"]) > 0).join(of_row.withColumnRenamed("row", row), row, "left")
    clean = found.where(F.size(names["matches"]) == 0).select(*keep, *[(none if i < 2 else F.lit(0).cast("long")).alias(names[c]) for i, c in enumerate(new)])
    return result(held).union(clean)


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch that spans cover, sorted by start, replaced by the mark.

    A place in a text is found by counting from its begin, so spans are taken in as many groups as a group has spans, and a
    group's own stretch of the text is cut out first."""
    each = lambda column, use: F.element_at(F.transform(F.array(column), use), 1)  # noqa: E731  binds a value, else it would be found again at each use
    ends = lambda some: F.coalesce(F.array_max(F.transform(some, lambda s: s["end"])), F.lit(0))

    def group(j: Column, width: Column) -> Column:
        def cut(own: Column, from_: Column) -> Column:
            def stretch(part: Column) -> Column:
                def piece(s: Column, i: Column) -> Column:
                    at = F.greatest(from_, ends(F.slice(own, 1, i)))
                    return F.when(s["start"] >= at, F.concat(F.substring(part, at - from_ + 1, s["start"] - at), F.lit(mark))).otherwise(F.lit(""))

                return F.array_join(F.transform(own, piece), "")

            last = F.element_at(own, -1)["start"]
            return each(F.substring(text, from_ + 1, F.greatest(last - from_, F.lit(0))), stretch)

        return each(F.struct(F.slice(spans, j * width + 1, width).alias("own"), ends(F.slice(spans, 1, j * width)).alias("from")), lambda x: cut(x["own"], x["from"]))

    width = F.ceil(F.sqrt(F.size(spans))).cast("int")
    groups = F.sequence(F.lit(0), F.ceil(F.size(spans) / width).cast("int") - 1)
    return F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(groups, lambda j: group(j, width)), ""), F.substring(text, ends(spans) + 1, F.length(text)))).otherwise(text)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = secret_scan(docs, keep=["doc_id"])
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[n(k[0]) for k in BASE], F.sha2(spelled(F.col("base_spans")), 256).alias("base_sha256"), spelled(F.col("secret_spans")).alias("spans"), "n_live", "n_example")
