"""Multipart bodies: parts of odd bodies, repeated names, and the folder source."""

from __future__ import annotations

import email
import random
import tempfile
from email.policy import HTTP
from pathlib import Path

import pytest

from pagewarden.sources import multipart as M


def body(parts: list[tuple], boundary: str = "B") -> bytes:
    out = b""
    for head, payload in parts:
        out += f"--{boundary}\r\n{head}\r\n\r\n".encode() + payload + b"\r\n"
    return out + f"--{boundary}--\r\n".encode()


def test_binary_parts_against_the_mail_parser():
    rng = random.Random(3)
    for _ in range(60):
        parts = [(f'Content-Disposition: form-data; name="n{k}"; filename="f {k}.png"\r\nContent-Type: image/png', bytes(rng.choice([13, 10, 45, 66, 0, 255]) for _ in range(rng.randint(0, 40)))) for k in range(rng.randint(1, 4))]
        parts = [(h, p) for h, p in parts if b"\r\n--B" not in b"\r\n" + p + b"\r\n"]
        if not parts:
            continue
        status, got = M.split_parts(body(parts), b"B")
        assert status == "OK" and [g[3] for g in got] == [p for _, p in parts]
        plain = email.message_from_bytes(b'Content-Type: multipart/form-data; boundary="B"\r\n\r\n' + body([(h, b"x") for h, _ in parts]), policy=HTTP)
        assert [(p.get_param("name", header="content-disposition"), p.get_filename(), p.get_content_type()) for p in plain.iter_parts()] == [g[:3] for g in got]


@pytest.mark.parametrize("data, status, names", [
    (b"", "NO_PARTS", []), (b"--B--\r\n", "NO_PARTS", []), (b"no boundary here", "NO_PARTS", []),
    (b"--B\r\nContent-Disposition: form-data; name=a\r\n\r\nx", "UNTERMINATED", []),
    (b"--B\r\nContent-Disposition: form-data; name=a\r\n\r\nx\r\n--B\r\nCont", "UNTERMINATED", ["a"]),
    (b"--B\r\n\r\nno header\r\n--B\r\nContent-Disposition: form-data; name=\"b\"\r\n\r\n\r\n--B--", "BAD_PART", ["b"]),
    (b"pre\r\n--B\r\ncontent-disposition: form-data; filename=\"x;y.png\"; name=\"a \\\"q\\\"\"\r\n\r\n--B-like\r\n--B--", "OK", ['a "q"']),
])
def test_odd_bodies(data, status, names):
    got = M.split_parts(data, b"B")
    assert got[0] == status and [g[0] for g in got[1]] == names


def test_rows_of_requests(spark):
    good = body([('Content-Disposition: form-data; name="image"; filename="a.png"\r\nContent-Type: image/png', b"\x00\r\n\xff"), ('Content-Disposition: form-data; name="x"', "é".encode())])
    rows = [(1, 'multipart/form-data; boundary="B"', good), (2**53 + 1, "multipart/form-data", good), (None, "Multipart/Form-Data; charset=u; boundary=B", good), (3, None, None), (4, "multipart/form-data; boundary=B", None)]
    frame = spark.createDataFrame(rows, "request_id long, content_type string, body binary").coalesce(1)
    got = {(r.request_id, r.nth): (r.status, r.name, r.file_name, None if r.payload is None else bytes(r.payload)) for r in M.parts(frame).collect()}
    image, word = ("OK", "image", "a.png", b"\x00\r\n\xff"), ("OK", "x", None, "é".encode())
    assert got == {(1, 1): image, (1, 2): word, (None, 1): image, (None, 2): word, (2**53 + 1, None): ("NO_BOUNDARY", None, None, None), (3, None): ("NOT_MULTIPART", None, None, None), (4, None): ("NO_PARTS", None, None, None)}
    assert M.parts(frame.limit(0)).collect() == []


def test_folder_source(spark, monkeypatch):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    for k in range(7):
        (folder / f"r{k}.bin").write_bytes(body([('Content-Disposition: form-data; name="a"', bytes([k] * 10)), ('Content-Disposition: form-data; name="a"', b"again")], f"x{k}"))
    (folder / "broken").write_bytes(b"nothing")
    (folder / "_hidden").write_bytes(b"--x\r\n")
    monkeypatch.setattr(M, "PARTITION_BYTES", 300)
    assert len(M.MultipartReader(str(folder)).partitions()) >= 4
    got = M.read_folder(spark, f"file://{folder}").collect()
    assert sorted((r.file, r.nth, bytes(r.payload)) for r in got if r.name) == sorted((f"r{k}.bin", n, p) for k in range(7) for n, p in ((1, bytes([k] * 10)), (2, b"again")))
    assert [(r.file, r.status) for r in got if not r.name] == [("broken", "NO_BOUNDARY")]
