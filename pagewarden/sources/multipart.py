"""Multipart form bodies: parts as rows, from a column of bodies or from a folder of them, and the uploads that they make up."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.ids import exact, ids_of
from . import requests

PART_SCHEMA = "status string, nth int, name string, file_name string, content_type string, payload binary"
#: Bytes of files that a partition of the folder source reads, about.
PARTITION_BYTES = 32 << 20


def header_value(header: str, name: str) -> str | None:
    """A parameter of a header, quoted or not; a backslash in quotes stands before the character that it keeps."""
    rest = header.partition(";")[2]
    while rest:
        key, _, rest = rest.partition("=")
        rest = rest.lstrip()
        if rest.startswith('"'):
            value, at = "", 1
            while at < len(rest) and rest[at] != '"':
                at += rest[at] == "\\" and at + 1 < len(rest)
                value, at = value + rest[at : at + 1], at + 1
            rest = rest[at + 1 :].lstrip().removeprefix(";")
        else:
            value, _, rest = rest.partition(";")
            value = value.strip()
        if key.strip().lower() == name:
            return value
    return None


def split_parts(body: bytes, boundary: bytes) -> tuple[str, list[tuple]]:
    """The status of a body, and name, file name, content type and payload of its parts in order.

    OK, NO_PARTS, UNTERMINATED (what was found up to the missing end comes all the same) or BAD_PART (a part without a header or a name, left out).
    """
    marks = list(re.finditer(rb"(?:\A|\r\n)--" + re.escape(boundary) + rb"(--|(?=[ \t]*\r\n))", body))
    out, status = [], "OK"
    for k, mark in enumerate(marks):
        if mark[1]:
            return ("NO_PARTS" if status == "OK" and not out else status), out
        if k + 1 == len(marks):
            break
        part = body[body.index(b"\r\n", mark.end()) + 2 : marks[k + 1].start()]
        head, blank, payload = part.partition(b"\r\n\r\n")
        if part.startswith(b"\r\n"):
            head = b""
        fields = {n.strip().lower(): v.strip() for n, _, v in (h.partition(":") for h in head.decode("utf-8", "replace").split("\r\n"))}
        name = header_value(fields.get("content-disposition", ""), "name")
        if not blank or name is None:
            status = "BAD_PART"
        else:
            out.append((name, header_value(fields["content-disposition"], "filename"), fields.get("content-type"), payload))
    return ("UNTERMINATED" if marks else "NO_PARTS"), out


def part_rows(body: bytes | None, content_type: str | None) -> list[tuple]:
    """Rows of PART_SCHEMA of one request; one row of nulls but for the status where there is no part."""
    kind = (content_type or "").partition(";")[0].strip().lower()
    boundary = header_value(content_type or "", "boundary")
    if kind != "multipart/form-data":
        status, found = "NOT_MULTIPART", []
    elif not boundary:
        status, found = "NO_BOUNDARY", []
    else:
        status, found = split_parts(body or b"", boundary.encode())
    return [(status, k + 1, *part) for k, part in enumerate(found)] or [(status, None, None, None, None, None)]


def parts(rows: DataFrame) -> DataFrame:
    """request_id and PART_SCHEMA for every part of ``rows`` (request_id, content_type, body); a request without parts keeps a row with its status.

    Null bodies are empty; rows without request_id keep their parts apart from each other by nothing but their order.
    """
    columns = [c.split()[0] for c in PART_SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            found = [part_rows(None if body is None else bytes(body), kind) for body, kind in zip(pdf["body"], pdf["content_type"], strict=True)]
            out = pd.DataFrame([r for rs in found for r in rs], columns=columns).astype({"nth": "Int32"})
            out.insert(0, "request_id", ids_of(pdf, "request_id")[[k for k, rs in enumerate(found) for _ in rs]])
            yield out

    return rows.select(*exact("request_id"), "content_type", "body").mapInPandas(run, f"request_id long, {PART_SCHEMA}")


def form_uploads(found: DataFrame, key: str = "request_id") -> DataFrame:
    """The uploads of ``parts``: what ``requests.uploads`` makes of the last part of each name, and NO_IMAGE, or the fault of the body, where there is no image.

    An image is a part with that name and a file name.
    """
    named = lambda n: F.col("name") == n
    last = lambda n, c: F.max_by(c, F.when(named(n), F.col("nth")))
    is_image = named("image") & F.col("file_name").isNotNull()
    text = F.decode("payload", "UTF-8")
    rows = found.groupBy(key).agg(
        F.max("status").alias("body_status"), F.coalesce(F.bool_or(is_image), F.lit(False)).alias("has_image"),
        F.max_by("content_type", F.when(is_image, F.col("nth"))).alias("content_type"), F.max_by("file_name", F.when(is_image, F.col("nth"))).alias("file_name"),
        F.max_by(F.octet_length("payload"), F.when(is_image, F.col("nth"))).alias("bytes"),
        last("redaction_regions", text).alias("redaction_regions"), last("privacy_proof", text).alias("privacy_proof"),
    )
    checked = requests.uploads(rows.withColumnRenamed(key, "request_id")).withColumnRenamed("request_id", key)
    fault = F.when(F.col("body_status") != "OK", F.col("body_status")).when(~F.col("has_image"), "NO_IMAGE")
    both = rows.select(key, fault.alias("fault"), "bytes").join(checked, key)
    return both.select(key, F.coalesce("fault", "status").alias("status"), F.when(F.col("fault").isNull(), F.col("suffix")).alias("suffix"), F.when(F.col("fault").isNull(), F.col("regions")).alias("regions"), F.when(F.col("fault").isNull(), F.col("bytes")).cast("long").alias("bytes"))


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class MultipartReader(DataSourceReader):
    """Reads a folder of bodies; a partition is some files, and each body's boundary is its first line."""

    def __init__(self, path: str):
        self.path = path

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{os.path.abspath(self.path)}")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._system()
        out, size = [[]], 0
        for info in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
                if out[-1] and size + info.size > PARTITION_BYTES:
                    out.append([])
                    size = 0
                out[-1].append(info.path)
                size += info.size
        return [_Files(names) for names in out]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = self._system()
        for name in partition.names:
            with system.open_input_stream(name) as source:
                body = source.read()
            first = body.partition(b"\r\n")[0].decode("utf-8", "replace").removeprefix("--")
            for row in part_rows(body, f'multipart/form-data; boundary="{first}"' if body.startswith(b"--") and first else "multipart/form-data"):
                yield (os.path.basename(name), *row)


class MultipartSource(DataSource):
    """``spark.read.format("multipart").load(folder)``: file and PART_SCHEMA of every part of the bodies in a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "multipart"

    def schema(self) -> str:
        return f"file string, {PART_SCHEMA}"

    def reader(self, schema) -> MultipartReader:
        return MultipartReader(self.options["path"])


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MultipartSource)
    return spark.read.format("multipart").load(path)


def form_body(fields: list[tuple[str, Column, str | None, str | None]], boundary: str) -> Column:
    """The body of a form: name, payload (binary), file name and content type of each part."""
    crlf, out = "\r\n", []
    for name, payload, file_name, kind in fields:
        head = f'--{boundary}{crlf}Content-Disposition: form-data; name="{name}"' + (f'; filename="{file_name}"' if file_name else "") + crlf + (f"Content-Type: {kind}{crlf}" if kind else "") + crlf
        out += [F.lit(head).cast("binary"), payload, F.lit(crlf).cast("binary")]
    return F.concat(*out, F.lit(f"--{boundary}--{crlf}").cast("binary"))
