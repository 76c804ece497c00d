"""Data models of source files: (name, source, fields, relations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.scalars import short_type
from lodestone.operators.extract import matches

FIELD = "struct<name:string,type:string,optional:boolean,unique:boolean,default:string,is_pk:boolean>"
RELATION = "struct<field:string,target:string,type:string>"


def _field(name: Column, kind: Column, optional: Column, unique: Column, default: Column, is_pk: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("type"), optional.alias("optional"), unique.alias("unique"), default.alias("default"), is_pk.alias("is_pk"))


def _known(rows: Column) -> Column:
    return F.filter(rows, lambda x: x.isNotNull())


def prisma(files: DataFrame) -> DataFrame:
    line = rules.PRISMA_LINE
    blocks = matches(files.filter(F.col("path").endswith(".prisma")), rules.PRISMA_MODEL, {"name": 1, "body": 2}, "path")
    rows = F.filter(F.transform(F.split("body", "\n"), lambda t: F.trim(t)), lambda t: (t != "") & ~t.startswith("//") & ~t.startswith("@@") & t.rlike(line))
    part = lambda t, g: F.regexp_extract(t, line, g)
    related = lambda t: part(t, 2).rlike("^[A-Z]") & ~part(t, 2).isin(*rules.PRISMA_SCALARS)
    many = lambda t: part(t, 3) != ""
    field = lambda t: _field(part(t, 1), F.concat(part(t, 2), F.when(many(t), "[]").otherwise("")), part(t, 4) == "?", part(t, 5).contains("@unique"), F.nullif(F.regexp_extract(part(t, 5), rules.PRISMA_DEFAULT, 1), F.lit("")), part(t, 5).contains("@id"))
    relation = lambda t: F.struct(part(t, 1).alias("field"), part(t, 2).alias("target"), F.when(many(t), "one-to-many").otherwise("one-to-one").alias("type"))
    return blocks.select("name", F.col("path").alias("source"), F.transform(F.filter(rows, lambda t: ~related(t)), field).alias("fields"), F.transform(F.filter(rows, related), relation).alias("relations"))


def drizzle(files: DataFrame) -> DataFrame:
    """Whether a field is optional or a key is read off the whole table, as far as no `serial` says otherwise."""
    blocks = matches(files.filter(F.col("ext").isin(".ts", ".js")), rules.DRIZZLE_TABLE, {"name": 1, "body": 2}, "path")
    pattern = rules.DRIZZLE_FIELD
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all("body", F.lit(pattern), F.lit(2)).alias("t"))
    body = F.col("body")
    field = lambda p: _field(p["n"], p["t"], body.contains(".default("), F.lit(False), F.lit(None).cast("string"), (p["t"] == "serial") | body.contains(".primaryKey()"))
    return blocks.select("name", F.col("path").alias("source"), F.transform(pairs, field).alias("fields"), F.array().cast(f"array<{RELATION}>").alias("relations"))


def django(files: DataFrame) -> DataFrame:
    """Flags are read off the whole class."""
    blocks = matches(files.filter(F.col("path").rlike(r"(?:^|/)models(?:\.py$|/.*\.py$)")), rules.DJANGO_MODEL, {"name": 1, "body": 2}, "path")
    pattern = rules.DJANGO_FIELD
    triple = F.arrays_zip(*[F.regexp_extract_all("body", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "n"), (2, "t"), (3, "target"))])
    links, body = ("ForeignKey", "OneToOneField", "ManyToManyField"), F.col("body")
    field = lambda p: _field(p["n"], p["t"], body.contains("null=True") | body.contains("blank=True"), body.contains("unique=True"), F.lit(None).cast("string"), (p["t"] == "AutoField") | (p["n"] == "id"))
    relation = lambda p: F.struct(p["n"].alias("field"), F.coalesce(F.nullif(p["target"], F.lit("")), F.lit("unknown")).alias("target"), F.when(p["t"] == "ManyToManyField", "many-to-many").when(p["t"] == "OneToOneField", "one-to-one").otherwise("one-to-many").alias("type"))
    return blocks.select("name", F.col("path").alias("source"), F.transform(F.filter(triple, lambda p: ~p["t"].isin(*links)), field).alias("fields"), F.transform(F.filter(triple, lambda p: p["t"].isin(*links)), relation).alias("relations"))


def typeorm(files: DataFrame) -> DataFrame:
    """The first class of a file that has column decorators."""
    own = files.filter(F.col("ext").isin(".ts", ".js") & F.col("content").rlike(rules.TYPEORM_ENTITY))
    column = rules.TYPEORM_COLUMN
    link = rules.TYPEORM_RELATION
    zipped = lambda p: F.arrays_zip(*[F.regexp_extract_all("content", F.lit(p), F.lit(g)).alias(n) for g, n in ((1, "d"), (2, "n"), (3, "t"))])
    field = lambda p: _field(p["n"], p["t"], p["d"].contains("nullable: true"), p["d"].contains("unique: true"), F.lit(None).cast("string"), p["d"].contains("PrimaryGeneratedColumn") | p["d"].contains("PrimaryColumn"))
    relation = lambda p: F.struct(p["n"].alias("field"), p["t"].alias("target"), F.when(p["d"] == "ManyToMany", "many-to-many").when(p["d"] == "OneToMany", "one-to-many").otherwise("one-to-one").alias("type"))
    return own.select(F.regexp_extract("content", r"class\s+(\w+)", 1).alias("name"), F.col("path").alias("source"), F.transform(zipped(column), field).alias("fields"), F.transform(zipped(link), relation).alias("relations")).filter("name != ''")


def models(files: DataFrame) -> DataFrame:
    plain = lambda df: df.select("name", "source", F.col("fields").cast(f"array<{FIELD}>").alias("fields"), F.col("relations").cast(f"array<{RELATION}>").alias("relations"))
    return reduce(DataFrame.unionByName, [plain(p(files)) for p in (prisma, drizzle, django, typeorm)])


def look_up(found: DataFrame, name: str | None = None) -> DataFrame:
    """All models with counts of keys and relations, or one (any case) with the models that refer to it."""
    if name is None:
        return found.select("name", "source", F.size("fields").alias("fields"), F.size(F.filter("fields", lambda f: f["is_pk"])).alias("keys"), F.size("relations").alias("relations"))
    own = found.filter(F.lower("name") == name.lower())
    incoming = found.select(F.col("name").alias("referrer"), F.explode("relations").alias("r")).groupBy(F.col("r.target").alias("name")).agg(F.array_sort(F.collect_set("referrer")).alias("referrers"))
    return own.join(incoming, "name", "left")


def model_text(found: DataFrame) -> DataFrame:
    """(name, text): fields with short types and marks, then relations."""
    field = lambda f: F.concat(f["name"], F.lit("("), short_type(f["type"]), F.when(f["is_pk"], ",pk").otherwise(""), F.when(f["unique"], ",uniq").otherwise(""), F.lit(")"), F.when(f["optional"], "?").otherwise(""))
    relation = lambda r: F.concat(r["field"], F.lit("→"), r["target"], F.when(r["type"] == "one-to-many", "[]").otherwise(""))
    tail = F.when(F.size("relations") > 0, F.concat(F.lit("\n    → "), F.array_join(F.transform("relations", relation), ", "))).otherwise("")
    return found.select("name", F.concat(F.lit("  "), "name", F.lit(": "), F.array_join(F.transform("fields", field), ", "), tail).alias("text"))
