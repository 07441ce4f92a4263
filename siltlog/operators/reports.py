"""Reports over a log: figures as DataFrames, with a summary and caveats, as text, Markdown or JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import dead_fraction
from .accounting import located, sealed_spans, segment_bytes, standing
from .reads import column_totals
from .resolve import resolve
from .schema import Registry


def ranked_segments(segments: DataFrame) -> DataFrame:
    """segment, live, dead, held and dead_fraction, with the place by dead fraction; nothing is cut, so that totals can be taken first."""
    rows = segments.withColumn("dead_fraction", dead_fraction(F.col("dead"), F.col("live")))
    return rows.select(F.col("segment_id").alias("segment"), "live", "dead", "held", "dead_fraction")


def sequence_report(log: DataFrame, limit: int = 0) -> DataFrame:
    """The segments by dead fraction, the deadest first; a limit of 0 lists all."""
    rows = ranked_segments(segment_bytes(log)).orderBy(F.col("dead_fraction").desc(), "segment")
    return rows.limit(limit) if limit else rows


def stat_report(log: DataFrame, registry: Registry) -> DataFrame:
    """column, id, runs, records and bytes of each declared family."""
    declared = log.sparkSession.createDataFrame([(f.name, f.id) for f in registry.families], "cf string, id short")
    held, spans = column_totals(resolve(log, carry=("len",))), sealed_spans(log)
    return declared.join(held, "cf", "left").join(spans, "cf", "left").select(F.col("cf").alias("column"), "id", F.coalesce("sealed_segments", F.lit(0)).alias("runs"), F.coalesce("n", F.lit(0)).alias("records"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def summary(log: DataFrame) -> DataFrame:
    """One row: sequence, segments, live, dead and tombstone bytes, dead share, graves and covers."""
    segs = segment_bytes(log).agg(F.coalesce(F.max("max_lsn"), F.lit(0)).alias("newest"), F.count("*").alias("segments"), F.coalesce(F.sum("live"), F.lit(0)).alias("live_bytes"), F.coalesce(F.sum("dead"), F.lit(0)).alias("dead_bytes"), F.coalesce(F.sum("held"), F.lit(0)).alias("tombstone_bytes"))
    one = segs.withColumn("sequence", F.col("newest") + 1).drop("newest").withColumn("dead_share", dead_fraction(F.col("dead_bytes"), F.col("live_bytes")))
    return one.join(standing(log), F.lit(True))


def column_spans(log: DataFrame, registry: Registry) -> DataFrame:
    """column, id and sealed_segments of each declared family, also of empty ones."""
    declared = log.sparkSession.createDataFrame([(f.name, f.id) for f in registry.families], "column string, id short")
    return declared.join(sealed_spans(log).withColumnRenamed("cf", "column"), "column", "left").select("column", "id", F.coalesce("sealed_segments", F.lit(0)).alias("sealed_segments"))


def faulty(log: DataFrame) -> DataFrame:
    """Records whose payload doesn't have the checksum that was written with it."""
    return log.where(F.crc32(F.coalesce("v", F.lit(b""))) != F.col("crc"))


def verify_report(log: DataFrame, known: list[int], limit: int = 0) -> DataFrame:
    """segment, sealed, indexed, records, bytes, faults, dead and the first fault: faults first, empty ones last. Every published segment is sealed."""
    rows = located(log).withColumn("bad", F.crc32(F.coalesce("v", F.lit(b""))) != F.col("crc"))
    told = F.concat(F.lit("checksum of "), F.col("cf"), F.lit(" "), F.lower(F.hex("k")), F.lit(" at "), F.col("lsn").cast("string"))
    sums = rows.groupBy(F.col("segment_id").alias("segment")).agg(
        F.count("*").alias("records"), F.sum(F.col("len").cast("long")).alias("bytes"), F.count_if("bad").alias("faults"), F.count_if((F.col("kind") == 0) & ~F.col("is_live")).alias("dead"),
        F.min(F.when(F.col("bad"), F.struct("lsn", told.alias("fault")))).alias("first"),
    )
    listed = log.sparkSession.createDataFrame([(s,) for s in known], "segment int").withColumn("indexed", F.lit(True))
    out = sums.join(listed, "segment", "full").select("segment", F.lit(True).alias("sealed"), F.coalesce("indexed", F.lit(False)).alias("indexed"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "bytes", "faults", "dead")), F.col("first.fault").alias("fault"))
    out = out.orderBy(F.col("faults").desc(), (F.col("records") == 0).asc(), "segment")
    return out.limit(limit) if limit else out


def human_bytes(n: int) -> str:
    size, unit = float(n), "B"
    for unit in ("B", "KiB", "MiB", "GiB", "TiB", "PiB"):
        if size < 1024 or unit == "PiB":
            break
        size /= 1024
    return f"{n} B" if unit == "B" else f"{size:.1f} {unit}"


def percent(share: float) -> str:
    return f"{100 * share:.1f}%"


def plural(n: int, noun: str) -> str:
    return f"{n} {noun}" if n == 1 else f"{n} {noun}s"


@dataclass
class Document:
    """A report made ready: a title, figures, tables and what the figures leave out."""

    title: str
    figures: Mapping[str, object] = field(default_factory=dict)
    tables: Mapping[str, list[Mapping[str, object]]] = field(default_factory=dict)
    caveats: list[tuple[str, str | None]] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"title": self.title, **self.figures, **self.tables, "caveats": [{"what": w, "fix": f} for w, f in self.caveats]}, indent=2, default=str)

    def to_markdown(self) -> str:
        out = [f"# {self.title}", "", *(f"- {k}: {v}" for k, v in self.figures.items())]
        for name, rows in self.tables.items():
            out += ["", f"## {name}", ""]
            if rows:
                out += ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(str(v).replace("|", "\\|") for v in r.values()) + " |" for r in rows)]
        return "\n".join([*out, *([""] if self.caveats else []), *(f"> {w}" + (f" ({f})" if f else "") for w, f in self.caveats)]) + "\n"

    def to_text(self) -> str:
        wide = max(map(len, self.figures), default=0)
        out = [self.title, *(f"  {k.ljust(wide)}  {v}" for k, v in self.figures.items())]
        for name, rows in self.tables.items():
            out.append(f"{name}:")
            if rows:
                cells = [list(rows[0]), *([str(v) for v in r.values()] for r in rows)]
                widths = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
                out += ["  " + "  ".join(c.rjust(w) for c, w in zip(r, widths)) for r in cells]
        return "\n".join([*out, *(f"note: {w}" + (f"; {f}" if f else "") for w, f in self.caveats)]) + "\n"


def document(title: str, figures: DataFrame, tables: Mapping[str, DataFrame], limit: int = 0, caveats: list[tuple[str, str | None]] | None = None) -> Document:
    """A document of one row of figures and of tables with at most ``limit`` rows each (0: all, which are read partition by partition)."""
    rows = {k: [r.asDict() for r in (v.limit(limit).collect() if limit else v.toLocalIterator())] for k, v in tables.items()}
    first = figures.first()
    return Document(title, first.asDict() if first else {}, rows, caveats or [])
