"""Sources and sinks: folders of text, structured claims, admission with idempotency."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings and the kind of document that they hold.
KINDS = {".txt": "plain", ".md": "markdown"}


def folder(spark: SparkSession, path: str, most: int = 10_000) -> DataFrame:
    """(name, kind, text, content_hash, status) of the files of a folder, not of those below it.

    Files of other kinds, or that aren't UTF-8, are rows with the reason; more
    than ``most`` files are an error.
    """
    files = spark.read.format("binaryFile").load(path.rstrip("/") + "/*")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ending = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[ending]
    status = F.when(kind.isNull(), "unsupported kind").when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8").when(F.length("content") == 0, "empty").otherwise("accepted")
    rows = files.select(name.alias("name"), kind.alias("kind"), F.when(status == "accepted", F.col("content").cast("string")).alias("text"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), status.alias("status"))
    if rows.count() > most:
        raise ValueError(f"more than {most} files")
    return rows


CLAIM = ["subject_id", "relation", "object_kind", "object_id", "datatype"]


def structured(spark: SparkSession, path: str) -> DataFrame:
    """The claims of JSON documents {"claims": [{subject_id, relation, object_kind, object_id, datatype}]}."""
    schema = "claims array<struct<subject_id:string,relation:string,object_kind:string,object_id:string,datatype:string>>"
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").select(F.inline("claims"))


#: Ranges of the integer types.
INTEGERS = {
    "xsd:byte": (-128, 127), "xsd:short": (-32768, 32767), "xsd:int": (-(2**31), 2**31 - 1), "xsd:long": (-(2**63), 2**63 - 1),
    "xsd:unsignedByte": (0, 255), "xsd:unsignedShort": (0, 65535), "xsd:unsignedInt": (0, 2**32 - 1), "xsd:unsignedLong": (0, 2**64 - 1),
    "xsd:integer": (None, None), "xsd:nonNegativeInteger": (0, None), "xsd:positiveInteger": (1, None), "xsd:nonPositiveInteger": (None, 0), "xsd:negativeInteger": (None, -1),
}


def literal_error(value: Column, datatype: Column) -> Column:
    """Why a literal isn't of its datatype, or null."""
    whole = value.rlike(r"^[+-]?\d{1,38}$")
    exact = F.when(whole, value.try_cast("decimal(38,0)"))
    out = F.when(datatype == "xsd:boolean", F.when(~value.isin("true", "false", "0", "1"), "not a boolean"))
    out = out.when(datatype == "xsd:decimal", F.when(~value.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), "not a decimal"))
    out = out.when(datatype == "xsd:date", F.when(~value.rlike(r"^-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$") | F.substring(value, 1, 10).try_cast("date").isNull(), "not a date"))
    out = out.when(datatype == "xsd:dateTime", F.when(value.try_cast("timestamp").isNull(), "not a time"))
    for name, (low, high) in INTEGERS.items():
        bad = ~whole | exact.isNull()
        if low is not None:
            bad = bad | (exact < F.lit(Decimal(low)))
        if high is not None:
            bad = bad | (exact > F.lit(Decimal(high)))
        out = out.when(datatype == name, F.when(bad, "not within " + name))
    return out


def validate(claims: DataFrame, vocabulary: dict[str, tuple[str, Decimal | None]]) -> DataFrame:
    """claims with ``status``: accepted, or the first reason against.

    vocabulary: relation -> (object kind, greatest number or None).
    """
    kinds = F.create_map(*[F.lit(x) for r, (k, _) in vocabulary.items() for x in (r, k)])
    tops = F.create_map(*[x for r, (_, m) in vocabulary.items() for x in (F.lit(r), F.lit(m).cast("decimal(38,6)"))])
    wrong = literal_error(F.col("object_id"), F.col("datatype"))
    status = (
        F.when(F.col("subject_id").isNull() | (F.col("subject_id") == "") | (F.octet_length("subject_id") > 4096), "subject")
        .when(F.col("relation").isNull() | kinds[F.col("relation")].isNull(), "unknown relation")
        .when(~F.col("object_kind").eqNullSafe(kinds[F.col("relation")]), "object of another kind")
        .when(F.col("object_id").isNull(), "object")
        .when((F.col("object_kind") == "literal") & wrong.isNotNull(), wrong)
        .when((F.col("object_kind") == "literal") & (F.col("object_id").try_cast("decimal(38,6)") > tops[F.col("relation")]), "literal out of range")
        .otherwise("accepted")
    )
    return claims.withColumn("status", status)


def claim_id(import_name: str) -> Column:
    """An id that an import's name and a claim's content determine."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in CLAIM]
    return F.concat(F.lit("claim:"), F.sha2(F.concat(F.lit(f"{len(import_name)}:{import_name}"), *parts), 256))


class Store:
    """An append-only table of admitted batches; a batch's key admits it once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _receipts(self) -> dict[str, tuple[int, int]]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = {}
        if fs.exists(at):
            for s in fs.listStatus(at):
                name = s.getPath().getName()
                if name.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                    seq, time, key = name[6:].split("~", 2)
                    out[key] = (int(seq), int(time))
        return out

    def admit(self, batch: DataFrame, key: str, wall_millis: int, closed_millis: int = 0) -> tuple[int, int]:
        """(number, time) of the batch; time rises with every batch, whatever the clock says."""
        from claimloom.operators.temporal import allocate

        if not key or "~" in key or "/" in key:
            raise ValueError("batch key")
        held = self._receipts()
        if key in held:
            return held[key]
        seq = 1 + max((s for s, _ in held.values()), default=0)
        time = allocate(wall_millis, max((t for _, t in held.values()), default=0), closed_millis)
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={seq}~{time}~{key}")
        return seq, time

    def read(self, through: int | None = None) -> DataFrame:
        """Rows of all batches, or of those up to a number, with ``seq``."""
        parts = [f"{self.path}/batch={s}~{t}~{k}" for k, (s, t) in self._receipts().items() if through is None or s <= through]
        if not parts:
            raise LookupError("nothing admitted")
        got = self.spark.read.option("basePath", self.path).parquet(*parts)
        return got.withColumn("seq", F.split_part("batch", F.lit("~"), F.lit(1)).cast("long")).drop("batch")


def canonical_sink(paths: DataFrame, path: str) -> None:
    """Rows as JSON objects, one a line, in rank order."""
    paths.orderBy("rank").select(F.to_json(F.struct(*sorted(paths.columns))).alias("value")).coalesce(1).write.mode("errorifexists").text(path)
