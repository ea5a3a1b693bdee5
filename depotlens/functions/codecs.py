"""Binary formats of the depot: varints, hash lists, file records, pack entries, canonical nodes and release packages.

Pure Python over bytes, used inside Arrow-batched functions; every encoder has its decoder here.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

# Fixed values of the formats.
RECORD_MAGIC, RECORD_VERSION = b"BSFD", 1
PACK_MAGIC, PACK_VERSION = b"BSPK", 1
PACKAGE_MAGIC, PACKAGE_VERSION = b"BPKG", 6
HASH_BYTES = 32
LEVEL = 9

#: Widths of the integer kinds; signed ones are zigzag coded.
KINDS = {"ushort": (16, False), "int": (32, True), "uint": (32, False), "long": (64, True), "ulong": (64, False)}


class FormatError(ValueError):
    """Bytes that are not what the format promises."""


# ---- integers


def write_varint(value: int, kind: str = "ulong") -> bytes:
    bits, signed = KINDS[kind]
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    if not low <= value <= high:
        raise OverflowError(f"{value} is no {kind}")
    v = ((value << 1) ^ (value >> bits - 1)) & ((1 << bits) - 1) if signed else value
    out = bytearray()
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


class Cursor:
    """Reads a buffer from front to back and refuses to read past its end."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def __bool__(self) -> bool:
        return self.at < len(self.data)

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError("unexpected end")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def varint(self, kind: str = "ulong") -> int:
        bits, signed = KINDS[kind]
        v = shift = 0
        while True:
            b = self.byte()
            v |= (b & 0x7F) << shift
            if v >> bits:
                raise FormatError(f"varint too large for {kind}")
            shift += 7
            if b < 0x80:
                break
            if shift >= bits:
                raise FormatError("varint too long")
        return (v >> 1) ^ -(v & 1) if signed else v

    def text(self) -> str:
        """A string with its length in front."""
        return self.take(self.varint("uint")).decode()


def read_bits(data: bytes, widths: Sequence[int]) -> list[int]:
    """Values of the given widths (0 to 64) from the least significant bit of each byte on."""
    whole, at, out = int.from_bytes(data, "little"), 0, []
    for w in widths:
        if not 0 <= w <= 64 or at + w > 8 * len(data):
            raise FormatError("bits past the end")
        out.append(whole >> at & (1 << w) - 1)
        at += w
    return out


def write_bits(values: Sequence[int], widths: Sequence[int]) -> bytes:
    whole = at = 0
    for v, w in zip(values, widths):
        whole |= (v & (1 << w) - 1) << at
        at += w
    return whole.to_bytes((at + 7) // 8, "little")


# ---- hash lists and file records


def _zstd():
    import zstandard

    return zstandard


def encode_hashes(hashes: Sequence[bytes]) -> bytes:
    """A list of 32-byte hashes, byte columns compressed one by one, in order."""
    if not hashes:
        return b"\0\0"
    for h in hashes:
        if len(h) != HASH_BYTES:
            raise FormatError(f"a hash has {len(h)} bytes")
    joined, z = b"".join(hashes), _zstd().ZstdCompressor(level=LEVEL)
    out = [write_varint(len(hashes), "int")]
    for c in range(HASH_BYTES):
        body = z.compress(joined[c::HASH_BYTES])
        out += [write_varint(len(body), "int"), body]
    return b"".join(out)


def decode_hashes(data: bytes | Cursor) -> list[bytes]:
    c = data if isinstance(data, Cursor) else Cursor(data)
    n = c.varint("int")
    if n == 0:
        return []
    z = _zstd().ZstdDecompressor()
    columns = []
    for _ in range(HASH_BYTES):
        column = z.decompress(c.take(c.varint("int")), max_output_size=max(n, 1))
        if len(column) != n:
            raise FormatError("a hash column has another length")
        columns.append(column)
    return [bytes(h) for h in zip(*columns)]


def encode_record(file_hash: bytes, length: int, hashes: Sequence[bytes]) -> bytes:
    """A file as the ordered list of its chunks."""
    if len(file_hash) != HASH_BYTES:
        raise FormatError("the file hash must have 32 bytes")
    return RECORD_MAGIC + struct.pack("<B32sqi", RECORD_VERSION, file_hash, length, len(hashes)) + encode_hashes(hashes)


def decode_record(data: bytes) -> tuple[bytes, int, list[bytes]]:
    head = struct.calcsize("<4sB32sqi")
    if len(data) < head:
        raise FormatError("record too short")
    magic, version, file_hash, length, count = struct.unpack_from("<4sB32sqi", data)
    if magic != RECORD_MAGIC or version != RECORD_VERSION:
        raise FormatError("no file record of a known version")
    hashes = decode_hashes(Cursor(data, head))
    if len(hashes) != count:
        raise FormatError("the record's count is wrong")
    return file_hash, length, hashes


def encode_batch(files: Sequence[tuple[bytes, int, Sequence[bytes]]]) -> bytes:
    """Many file records in one message: the distinct chunk hashes once, as a hash list, then each file's hash, length and chunk numbers."""
    numbers: dict[bytes, int] = {}
    for _, _, hashes in files:
        for h in hashes:
            numbers.setdefault(h, len(numbers))
    out = [encode_hashes(list(numbers)), write_varint(len(files), "uint")]
    for file_hash, length, hashes in files:
        if len(file_hash) != HASH_BYTES:
            raise FormatError("the file hash must have 32 bytes")
        out += [file_hash, write_varint(length), write_varint(len(hashes), "uint"), *(write_varint(numbers[h], "uint") for h in hashes)]
    return b"".join(out)


def decode_batch(data: bytes) -> list[tuple[bytes, int, list[bytes]]]:
    c = Cursor(data)
    hashes = decode_hashes(c)
    if not hashes:
        c.at = 2  # an empty list is two bytes
    out = []
    for _ in range(c.varint("uint")):
        file_hash, length = c.take(HASH_BYTES), c.varint()
        out.append((file_hash, length, [hashes[c.varint("uint")] for _ in range(c.varint("uint"))]))
    if c:
        raise FormatError("bytes after the last file")
    return out


# ---- packs

_PACK_HEAD = struct.Struct("<4sBIIQ")


def encode_pack_entry(data: bytes) -> bytes:
    import xxhash

    body = _zstd().ZstdCompressor().compress(data)
    return _PACK_HEAD.pack(PACK_MAGIC, PACK_VERSION, len(data), len(body), xxhash.xxh3_64_intdigest(body)) + body


def _pack_head(data: bytes, at: int, check: bool) -> tuple[int, int, int]:
    magic, version, length, size, digest = _PACK_HEAD.unpack_from(data, at)
    if check and (magic != PACK_MAGIC or version != PACK_VERSION):
        raise FormatError(f"no pack entry of a known version at {at}")
    return length, size, digest


def read_pack_entry(data: bytes, at: int = 0, check: bool = True) -> bytes:
    """The entry at an offset; magic, version, checksum and length are checked."""
    import xxhash

    if at + _PACK_HEAD.size > len(data):
        raise FormatError("incomplete header")
    length, size, digest = _pack_head(data, at, check)
    body = data[at + _PACK_HEAD.size : at + _PACK_HEAD.size + size]
    if len(body) != size:
        raise FormatError("entry cut off")
    if check and xxhash.xxh3_64_intdigest(body) != digest:
        raise FormatError("checksum mismatch")
    out = _zstd().ZstdDecompressor().decompress(body, max_output_size=max(1, length))
    if check and len(out) != length:
        raise FormatError("length mismatch")
    return out


def scan_pack(data: bytes, check: bool = True) -> Iterator[tuple[int, int, bytes]]:
    """(offset, stored size, content) of the entries of a pack, in order."""
    at = 0
    while at < len(data):
        content = read_pack_entry(data, at, check)
        size = _PACK_HEAD.size + _pack_head(data, at, check)[1]
        yield at, size, content
        at += size


def walk_pack(read_at: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int, int]]:
    """(offset, stored size, content length) of the entries of a pack of ``size`` bytes; ``read_at(n, offset)`` is asked for headers only."""
    at = 0
    while at < size:
        head = read_at(_PACK_HEAD.size, at)
        if len(head) < _PACK_HEAD.size:
            raise FormatError("incomplete header")
        length, body, _ = _pack_head(head, 0, True)
        if at + _PACK_HEAD.size + body > size:
            raise FormatError("entry cut off")
        yield at, _PACK_HEAD.size + body, length
        at += _PACK_HEAD.size + body


def pack_lengths(data: bytes) -> list[int]:
    """Content lengths from the headers alone."""
    at, out = 0, []
    while at + _PACK_HEAD.size <= len(data):
        length, size, _ = _pack_head(data, at, True)
        out.append(length)
        at += _PACK_HEAD.size + size
    return out


_LOG_ENTRY = struct.Struct("<32siqi")


def encode_log(entries: Sequence[tuple[bytes, int, int, int]]) -> bytes:
    """Index log: (hash, file number, offset, length) rows of fixed width."""
    return b"".join(_LOG_ENTRY.pack(*e) for e in entries)


def scan_log(data: bytes) -> list[tuple[bytes, int, int, int]]:
    """Entries of a log; a tail that was cut off is left out."""
    whole = len(data) // _LOG_ENTRY.size * _LOG_ENTRY.size
    return list(_LOG_ENTRY.iter_unpack(data[:whole]))


# ---- canonical nodes

NODE_KINDS = {"uvarint": 1, "bytes": 2, "utf8": 3, "hash32": 4, "vector": 5, "map": 6}


def _sized(b: bytes) -> bytes:
    return write_varint(len(b)) + b


def encode_node(node_type: int, fields: Sequence[tuple[int, str, Any]], magic: bytes = b"NODE", version: int = 1) -> bytes:
    """A node whose bytes depend on nothing but its content: fields by strictly rising id, maps by key bytes."""
    out, last = [magic, bytes([version, node_type])], 0
    for number, kind, value in fields:
        if number <= last:
            raise FormatError("field ids must rise strictly from 1")
        last = number
        if kind == "uvarint":
            body = write_varint(value)
        elif kind == "utf8":
            body = (value or "").encode()
        elif kind == "hash32":
            if len(value) != HASH_BYTES:
                raise FormatError("a hash must have 32 bytes")
            body = value
        elif kind == "map":
            rows = sorted((k.encode(), v) for k, v in value.items())
            body = write_varint(len(rows)) + b"".join(_sized(k) + (v if isinstance(v, bytes) else _sized(v.encode())) for k, v in rows)
        else:
            body = bytes(value)
        out += [write_varint(number, "uint"), write_varint(NODE_KINDS[kind], "uint"), _sized(body)]
    return b"".join(out)


# ---- release packages


@dataclass
class Artifact:
    """One output of a release.  Either ``content_hash`` and ``length`` (stored as it is), or ``format_id``, ``reconstruction``,
    ``recipe`` and ``members`` (rebuilt from parts): members are (entry path, hash, length)."""

    path: str
    kind: int = 0
    byte_perfect: bool = False
    content_hash: bytes | None = None
    length: int | None = None
    format_id: str | None = None
    reconstruction: int = 0
    recipe: bytes = b""
    members: list[tuple[str, bytes, int]] = field(default_factory=list)

    @property
    def container(self) -> bool:
        return self.format_id is not None


@dataclass
class Package:
    version: str
    release_id: str
    repo_id: str
    notes: str = ""
    created_at: int = 0
    properties: dict[str, str] = field(default_factory=dict)
    artifacts: list[Artifact] = field(default_factory=list)


def hash_order(h: bytes) -> tuple[int, ...]:
    """Hashes sort as four little-endian 64-bit words."""
    return struct.unpack("<4Q", h)


def _strings(table: Sequence[str]) -> bytes:
    raw = [s.encode() for s in table]
    return write_varint(len(raw), "uint") + b"".join(write_varint(len(b), "uint") for b in raw) + b"".join(raw)


def _read_strings(c: Cursor) -> list[str]:
    lengths = [c.varint("uint") for _ in range(c.varint("uint"))]
    return [c.take(n).decode() for n in lengths]


def encode_package(p: Package, compress: bool = True) -> bytes:
    """Nine sections: metadata, hashes, tokens, properties, artifacts, plain contents, containers, members, recipes."""
    u = lambda v: write_varint(v, "uint")
    artifacts = sorted(p.artifacts, key=lambda a: a.path.encode("utf-16-be", "surrogatepass"))
    boxes = [a for a in artifacts if a.container]
    plain = [a for a in artifacts if not a.container]
    for a in plain:
        if a.content_hash is None or a.length is None:
            raise FormatError(f"{a.path}: content hash and length are needed")
    hashes = sorted({a.content_hash for a in plain} | {h for a in boxes for _, h, _ in a.members}, key=hash_order)
    hash_at = {h: i for i, h in enumerate(hashes)}
    words = {w for a in artifacts for w in a.path.split("/")} | {a.format_id for a in boxes} | {w for a in boxes for m in a.members for w in m[0].split("/")} | {x for kv in p.properties.items() for x in kv}
    tokens = sorted(words, key=str.encode)
    token_at = {t: i for i, t in enumerate(tokens)}
    path = lambda s: u(len(s.split("/"))) + b"".join(u(token_at[w]) for w in s.split("/"))

    member_rows, box_rows = [], []
    for i, a in enumerate(boxes):
        box_rows.append(u(token_at[a.format_id]) + bytes([a.reconstruction]) + u(len(member_rows)) + u(len(a.members)) + u(i))
        member_rows += [path(e) + u(hash_at[h]) + write_varint(n) for e, h, n in a.members]
    listed = lambda rows: u(len(rows)) + b"".join(rows)
    text = lambda s: u(len(s.encode())) + s.encode()
    sections = [
        text(p.version) + text(p.release_id) + text(p.repo_id) + text(p.notes or "") + write_varint(p.created_at, "long"),
        encode_hashes(hashes),
        _strings(tokens),
        listed([u(token_at[k]) + u(token_at[v]) for k, v in p.properties.items()]),
        listed([path(a.path) + bytes([a.kind, a.byte_perfect, int(a.container)]) for a in artifacts]),
        listed([u(hash_at[a.content_hash]) + write_varint(a.length) for a in plain]),
        listed(box_rows),
        listed(member_rows),
        listed([u(len(a.recipe)) + a.recipe for a in boxes]),
    ]
    out = [PACKAGE_MAGIC, bytes([PACKAGE_VERSION, int(compress)])]
    z = _zstd().ZstdCompressor(level=LEVEL)
    for number, body in enumerate(sections, 1):
        if compress:
            body = z.compress(body)
        out += [bytes([number, 0]), _sized(body)]
    return b"".join(out)


def decode_package(data: bytes) -> Package:
    c = Cursor(data)
    if c.take(4) != PACKAGE_MAGIC:
        raise FormatError("no release package")
    version = c.byte()
    if version != PACKAGE_VERSION:
        raise FormatError(f"package version {version} is not supported")
    compressed = bool(c.byte() & 1)
    parts: dict[int, Cursor] = {}
    while c:
        number = c.byte()
        c.byte()
        body = c.take(c.varint())
        if compressed:
            body = _zstd().ZstdDecompressor().stream_reader(io.BytesIO(body)).read()
        parts[number] = Cursor(body)
    part = lambda n: parts.get(n, Cursor(b"\0\0"))
    meta = part(1)
    p = Package(meta.text(), meta.text(), meta.text(), meta.text(), meta.varint("long"))
    hashes, tokens = decode_hashes(part(2)), _read_strings(part(3))
    many = lambda s, f: [f(s) for _ in range(s.varint("uint"))]
    path = lambda s: "/".join(tokens[i] for i in many(s, lambda x: x.varint("uint")))
    p.properties = dict(many(part(4), lambda s: (tokens[s.varint("uint")], tokens[s.varint("uint")])))
    heads = many(part(5), lambda s: (path(s), *s.take(3)))
    plain = iter(many(part(6), lambda s: (hashes[s.varint("uint")], s.varint())))
    boxes = iter(many(part(7), lambda s: (tokens[s.varint("uint")], s.byte(), s.varint("uint"), s.varint("uint"), s.varint("uint"))))
    members = many(part(8), lambda s: (path(s), hashes[s.varint("uint")], s.varint()))
    recipes = many(part(9), lambda s: s.take(s.varint("uint")))
    for name, kind, perfect, container in heads:  # the k-th of each backing belongs to the k-th head of its sort
        a = Artifact(name, kind, bool(perfect))
        if container:
            a.format_id, a.reconstruction, first, count, recipe = next(boxes)
            a.members, a.recipe = members[first : first + count], recipes[recipe]
        else:
            a.content_hash, a.length = next(plain)
        p.artifacts.append(a)
    return p


def package_metrics(p: Package, data: bytes) -> dict[str, int]:
    """What writing a package came to: bytes, artifacts, members, and distinct hashes of plain contents and of all."""
    plain = {a.content_hash for a in p.artifacts if not a.container}
    return {"bytes": len(data), "artifacts": len(p.artifacts), "members": sum(len(a.members) for a in p.artifacts), "plain_hashes": len(plain), "hashes": len(plain | {h for a in p.artifacts for _, h, _ in a.members})}


# ---- settings


def unflatten(flat: Mapping[str, str]) -> dict[str, Any]:
    """Nested form of keys joined by colons; what comes later replaces a plain value that is in its way, and the other way round."""
    root: dict[str, Any] = {}
    for key, value in flat.items():
        *folders, last = key.split(":")
        at = root
        for f in folders:
            if not isinstance(at.get(f), dict):
                at[f] = {}
            at = at[f]
        at[last] = value
    return root


def flatten(nested: Any, section: str = "") -> dict[str, str]:
    """Keys joined by colons; list members by their number, null as an empty text."""
    if isinstance(nested, Mapping):
        items = list(nested.items())
    elif isinstance(nested, list):
        items = [(str(i), v) for i, v in enumerate(nested)]
    else:
        plain = "" if nested is None else str(nested).lower() if isinstance(nested, bool) else str(nested)
        return {section: plain}
    out: dict[str, str] = {}
    for k, v in items:
        out |= flatten(v, f"{section}:{k}" if section else k)
    return out
