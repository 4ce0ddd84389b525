"""What a file holds: inspection as a dictionary, as text, and whole files as JSON."""

from __future__ import annotations

import json
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as P
from ..functions import formatting
from ..functions.statistics import by_value, file_sizes
from ..operators.query import Table
from ..sources.footer import footer, list_files

#: The headings of the text report, in order.
HEADINGS = ("PARQUET FILE INSPECTION", "FILE INFORMATION", "SCHEMA STRUCTURE", "ROW GROUPS", "COLUMN CHUNK DETAILS (First Row Group)", "DATA SAMPLING", "STATISTICS SUMMARY")


def sample_size(rows: int) -> int:
    """How many rows a report shows: all up to 10, 10 up to 100, else 5."""
    return rows if rows <= 10 else 10 if rows <= 100 else 5


class Inspector:
    """One file's metadata, gathered once, and a few of its rows."""

    def __init__(self, spark: SparkSession, path: str):
        files = list_files(spark, path)
        if len(files) != 1:
            raise ValueError(f"{path} has {len(files)} data files; inspect them one by one")
        self.spark, self.path = spark, files[0]
        self.file = footer(spark, self.path, "files").first().asDict()
        self.groups = [r.asDict() for r in footer(spark, self.path, "row_groups").orderBy("row_group").collect()]
        self.chunks = [r.asDict() for r in footer(spark, self.path, "column_chunks").orderBy("row_group", "column").collect()]
        self.table = Table.open(spark, self.path, order=True)
        self.schema = self.table.schema

    def file_info(self) -> dict[str, Any]:
        out = {"filePath": self.path, "fileSizeBytes": self.file["size"], "fileSizeMB": self.file["size"] / 2**20, "formatVersion": self.file["version"], "totalRows": self.file["num_rows"], "rowGroups": self.file["num_row_groups"]}
        if "created_by" in self.file["key_values"]:
            out["createdBy"] = self.file["key_values"]["created_by"]
        return out | {"physicalColumns": len(self.schema.leaves), "logicalColumns": len(self.schema.columns)}

    def schema_info(self) -> dict[str, Any]:
        logical = []
        for i, c in enumerate(self.schema.columns):
            entry = {"index": i, "name": c.name, "logicalType": c.category}
            if c.category == P.PRIMITIVE:
                entry["physicalType"] = c.kind
            elif c.category == P.MAP:
                entry |= {"keyType": c.key_kind, "valueType": c.value_kind}
            logical.append(entry)
        physical = [{"index": i, "path": x.name, "physicalType": x.kind, "maxDefinitionLevel": x.max_def, "maxRepetitionLevel": x.max_rep, "repetitionType": x.repetition} for i, x in enumerate(self.schema.leaves)]
        return {"logicalColumns": logical, "physicalColumns": physical}

    def _sizes(self, group: int | None = None) -> tuple[int, int]:
        own = [c for c in self.chunks if group is None or c["row_group"] == group]
        return sum(c["total_uncompressed_size"] for c in own), sum(c["total_compressed_size"] for c in own)

    def row_group_info(self) -> dict[str, Any]:
        groups = []
        for g in self.groups:
            entry = {"index": g["row_group"], "numRows": g["num_rows"], "totalByteSize": g["total_byte_size"], "numColumns": g["num_columns"]}
            plain, packed = self._sizes(g["row_group"])
            if packed > 0:
                entry |= {"compressionRatio": plain / packed, "uncompressedSize": plain, "compressedSize": packed}
            groups.append(entry)
        return {"groups": groups, "count": len(groups)}

    def chunk_info(self) -> dict[str, Any]:
        chunks = []
        for c in self.chunks:
            if c["row_group"]:
                continue
            entry = {"index": c["column"], "path": c["path"], "type": c["type"], "codec": c["codec"], "numValues": c["num_values"], "totalUncompressedSize": c["total_uncompressed_size"], "totalCompressedSize": c["total_compressed_size"], "dataPageOffset": c["data_page_offset"]}
            if c["total_compressed_size"]:
                entry["compressionRatio"] = c["total_uncompressed_size"] / c["total_compressed_size"]
            if c["has_statistics"]:
                known = {"nullCount": c["null_count"], "distinctCount": c["distinct_count"], "min": c["min"] and formatting.statistic(c["min"], c["type"]), "max": c["max"] and formatting.statistic(c["max"], c["type"])}
                entry["statistics"] = {k: v for k, v in known.items() if v is not None}
            chunks.append(entry)
        return {"chunks": chunks, "rowGroupIndex": 0}

    def sampling(self) -> dict[str, Any]:
        total = self.file["num_rows"]
        out: dict[str, Any] = {"totalRows": total, "sampledRows": sample_size(total)}
        samples = []
        try:
            for i, row in enumerate(self.table.limit(sample_size(total)).rows()):
                group = next(g for g in reversed(self.groups) if g["first_row"] <= i)
                samples.append({"rowNumber": i, "rowGroup": group["row_group"], "rowIndexInGroup": i - group["first_row"], "values": {c.name: v for c, v in zip(self.schema.columns, row.values)}})
        except Exception as e:  # noqa: BLE001  a report shows what it can
            out["error"] = str(e)
        return out | {"samples": samples}

    def statistics(self) -> dict[str, Any]:
        rows, size = self.file["num_rows"], self.file["size"]
        out: dict[str, Any] = {"totalRows": rows, "totalFileSize": size, "averageRowSize": size / rows if rows else 0}
        plain, packed = self._sizes()
        if packed > 0:
            out |= {"totalUncompressedSize": plain, "totalCompressedSize": packed, "overallCompressionRatio": plain / packed, "bytesSaved": plain - packed}
        return out

    def as_dict(self) -> dict[str, Any]:
        out = {"fileInfo": self.file_info(), "schema": self.schema_info(), "rowGroups": self.row_group_info()}
        if self.groups:
            out["columnChunks"] = self.chunk_info()
        return out | {"dataSampling": self.sampling(), "statistics": self.statistics()}

    def as_json(self, pretty: bool = True) -> str:
        return json.dumps(self.as_dict(), indent=2 if pretty else None, default=_json, ensure_ascii=False)

    def as_text(self) -> str:
        info, out = self.as_dict(), ["=" * 80, HEADINGS[0], "=" * 80, ""]

        def section(heading: str, lines: list[str]) -> None:
            out.extend([heading, "-" * 80, *lines, ""])

        f = info["fileInfo"]
        section(HEADINGS[1], _aligned({"File Path": f["filePath"], "File Size": f"{f['fileSizeBytes']:,} bytes ({f['fileSizeMB']:.2f} MB)", "Format Version": f["formatVersion"], "Total Rows": f"{f['totalRows']:,}", "Row Groups": f["rowGroups"], "Created By": f.get("createdBy"), "Physical Columns": f["physicalColumns"], "Logical Columns": f["logicalColumns"]}))
        logical = [f"  [{i}] {c}" for i, c in enumerate(self.schema.columns)]
        section(HEADINGS[2], ["Logical Columns (User View):", *logical, "", "Physical Columns (Storage View):", *[f"  [{i}] {x}" for i, x in enumerate(self.schema.leaves)]])
        lines = []
        for g in info["rowGroups"]["groups"]:
            lines += [f"Row Group {g['index']}:", *_aligned({"Rows": f"{g['numRows']:,}", "Total Byte Size": f"{g['totalByteSize']:,} bytes", "Columns": g["numColumns"], "Compression Ratio": _ratio(g, "compressionRatio")}, "  ")]
        section(HEADINGS[3], lines)
        lines = [] if self.groups else ["No row groups found."]
        for c in info.get("columnChunks", {"chunks": []})["chunks"]:
            lines += [f"Column {c['index']}: {c['path']}", *_aligned({"Type": c["type"], "Compression": c["codec"], "Values": f"{c['numValues']:,}", "Uncompressed Size": f"{c['totalUncompressedSize']:,} bytes", "Compressed Size": f"{c['totalCompressedSize']:,} bytes", "Compression Ratio": _ratio(c, "compressionRatio"), "Data Page Offset": f"{c['dataPageOffset']:,}"}, "  ")]
            s = c.get("statistics")
            if s is not None:
                lines += ["  Statistics:", *_aligned({"Null Count": s.get("nullCount"), "Distinct Count": s.get("distinctCount"), "Min Value": s.get("min"), "Max Value": s.get("max")}, "    ")]
        section(HEADINGS[4], lines)
        d = info["dataSampling"]
        lines = [f"Showing {'all' if d['sampledRows'] == d['totalRows'] else 'first'} {d['sampledRows']} rows (of {d['totalRows']:,} total):"]
        for r in d["samples"]:
            lines += [f"Row {r['rowNumber']} (Row Group {r['rowGroup']}, Row Index {r['rowIndexInGroup']}):", *[f"  {k:<20} = {formatting.value(v)}" for k, v in r["values"].items()]]
        lines += [f"Error reading data: {d['error']}"] if "error" in d else []
        lines += [f"... ({d['totalRows'] - d['sampledRows']:,} more rows)"] if d["totalRows"] > d["sampledRows"] else []
        section(HEADINGS[5], lines)
        return "\n".join(out)

    def summary(self) -> str:
        s = self.statistics()
        saved = f"{s['overallCompressionRatio']:.2f}x (saved {s['bytesSaved']:,} bytes)" if "bytesSaved" in s else None
        lines = _aligned({"Total Rows": f"{s['totalRows']:,}", "Total File Size": f"{s['totalFileSize']:,} bytes ({s['totalFileSize'] / 2**20:.2f} MB)", "Average Row Size": f"{s['averageRowSize']:.2f} bytes", "Overall Compression": saved})
        return "\n".join([HEADINGS[6], "-" * 80, *lines])

    def metadata_text(self) -> str:
        """Version, rows, schema, row groups with their chunks, and key-value metadata."""
        out = ["=== Parquet File Metadata ===", f"Version: {self.file['version']}", f"Total rows: {self.file['num_rows']}", f"Number of row groups: {len(self.groups)}", "", "Schema:", *[f"  {x}" for x in self.schema.leaves], "", "Row Groups:"]
        for g in self.groups:
            out.append(f"  Row Group {g['row_group']}: {g['num_rows']} rows, {g['total_byte_size']} bytes")
            out += [f"    Column {c['column']} ({c['path']}): {c['type']}, codec={c['codec']}, values={c['num_values']}" for c in self.chunks if c["row_group"] == g["row_group"]]
        if self.file["key_values"]:
            out += ["", "Key-Value Metadata:", *[f"  {k}: {v}" for k, v in self.file["key_values"].items()]]
        return "\n".join(out)

    def json_metadata(self) -> dict[str, Any]:
        """The metadata part of a file's JSON export."""
        columns = []
        for c in self.schema.columns:
            entry: dict[str, Any] = {"name": c.name, "isMap": c.category == P.MAP}
            if c.category == P.MAP:
                entry |= {"type": P.MAP, "keyType": c.key_kind, "valueType": c.value_kind}
            else:
                leaf = self.schema.leaves[c.leaves[0]]
                entry |= {"type": leaf.kind, "maxDefinitionLevel": leaf.max_def, "maxRepetitionLevel": leaf.max_rep}
                own = [x for x in self.chunks if x["path"] == leaf.name]
                stats: dict[str, Any] = {}
                for bound in ("min", "max"):
                    raw = next((x[bound] for x in own if x[bound] is not None), None)
                    if raw is not None:
                        stats[bound] = formatting.statistic_json(raw, leaf.kind)
                stats["totalValues"] = sum(x["num_values"] for x in own)
                nulls = [x["null_count"] for x in own if x["null_count"] is not None]
                if nulls:
                    stats |= {"nullCount": sum(nulls), "nonNullCount": stats["totalValues"] - sum(nulls)}
                entry["statistics"] = stats
            columns.append(entry)
        groups = [{"index": g["row_group"], "numRows": g["num_rows"], "totalByteSize": g["total_byte_size"]} for g in self.groups]
        return {"version": self.file["version"], "numRows": self.file["num_rows"], "numRowGroups": len(groups), "numColumns": len(columns), "keyValueMetadata": self.file["key_values"], "columns": columns, "rowGroups": groups}


def _aligned(pairs: dict[str, Any], indent: str = "") -> list[str]:
    return [f"{indent}{k + ':':<20} {v}" for k, v in pairs.items() if v is not None]


def _ratio(entry: dict, key: str) -> str | None:
    return f"{entry[key]:.2f}x" if key in entry else None


def _json(v: Any) -> Any:
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "replace")
    return str(v)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object in the column `json`; nulls are kept, bytes are UTF-8 text."""
    columns = [F.decode(F.col(f"`{n}`"), "UTF-8").alias(n) if t == "binary" else F.col(f"`{n}`") for n, t in df.dtypes]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def export_json(spark: SparkSession, path: str, to: TextIO) -> None:
    """A file's metadata and rows as one JSON object; rows are streamed to `to` a partition at a time."""
    inspector = Inspector(spark, path)
    to.write('{"metadata": ' + json.dumps(inspector.json_metadata(), ensure_ascii=False, default=_json) + ', "rows": [')
    names = [c.name for c in inspector.schema.columns]
    ordered = inspector.table._ordered()
    for i, row in enumerate(json_rows(ordered.select(*[F.col(f"`{n}`") for n in names])).toLocalIterator()):
        to.write((",\n" if i else "\n") + row["json"])
    to.write("\n]}\n")


def export_json_lines(table: Table, path: str) -> None:
    """All rows as JSON lines in a folder, written in parallel."""
    json_rows(table.df.select(*[c.column() for c in table.schema.columns])).write.text(path)


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """File sizes and ratios of a whole folder, as a table."""
    return file_sizes(spark, path)


def profile(df: DataFrame) -> DataFrame:
    """For each plain column: values, nulls, distinct values, bounds, and the mean of numbers."""

    def measures(t: T.DataType) -> dict:
        v, n = F.col("v"), F.col("n")
        held, none = F.sum(F.when(v.isNotNull(), n)), F.sum(F.when(v.isNull(), n))
        mean = F.sum(v * n) / held if isinstance(t, T.NumericType) else F.lit(None)
        return {"values": F.coalesce(held, F.lit(0)), "nulls": F.coalesce(none, F.lit(0)), "distinct": F.count(v), "min": F.min(v).cast("string"), "max": F.max(v).cast("string"), "mean": mean.cast("double")}

    return by_value(df, measures)
