"""Mapbox vector tiles, version 2, extent 4096: projection, clipping, commands, layers."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Sequence

import numpy as np

from lodestrata.functions.expr import BUFFER, EXTENT, MAX_LATITUDE
from lodestrata.functions.wkb import Geometry

LOW, HIGH = -BUFFER, EXTENT + BUFFER


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, kind: int, body: bytes) -> bytes:
    return varint(number << 3 | kind) + (varint(len(body)) + body if kind == 2 else body)


def zigzag(n: int) -> int:
    return n << 1 ^ n >> 63


def round_up(x: np.ndarray) -> np.ndarray:
    f = np.floor(x)
    return f + (x - f >= 0.5)


def project(xy: np.ndarray, z: int, x: int, y: int) -> np.ndarray:
    """GEO-31: unrounded pixels; every vertex lies in the copy of the world nearest to the one before it."""
    n = 2.0**z
    world = n * EXTENT
    px = ((xy[:, 0] + 180.0) / 360.0 * n - x) * EXTENT
    before = np.concatenate([[EXTENT / 2], px[:-1]])
    shift = np.cumsum(round_up((before - px) / world)) if len(px) else px
    s = np.sin(np.radians(np.clip(xy[:, 1], -MAX_LATITUDE, MAX_LATITUDE)))
    py = ((0.5 - np.log((1 + s) / (1 - s)) / (4 * math.pi)) * n - y) * EXTENT
    return np.column_stack([px + shift * world, py])


def pixels_each(xy: np.ndarray, z: int, x: int, y: int) -> np.ndarray:
    """Rounded pixels of points that don't follow one another, each as ``project`` has it."""
    n = 2.0**z
    world = n * EXTENT
    px = ((xy[:, 0] + 180.0) / 360.0 * n - x) * EXTENT
    s = np.sin(np.radians(np.clip(xy[:, 1], -MAX_LATITUDE, MAX_LATITUDE)))
    py = ((0.5 - np.log((1 + s) / (1 - s)) / (4 * math.pi)) * n - y) * EXTENT
    return round_up(np.column_stack([px + round_up((EXTENT / 2 - px) / world) * world, py]))


def clip_ring(p: np.ndarray) -> np.ndarray:
    """GEO-29: a closed ring cut to the buffered tile, side by side."""
    for axis, edge, sign in ((0, LOW, 1), (0, HIGH, -1), (1, LOW, 1), (1, HIGH, -1)):
        if not len(p):
            return p
        q = np.roll(p, -1, axis=0)
        a, b = sign * (p[:, axis] - edge) >= 0, sign * (q[:, axis] - edge) >= 0
        out = []
        for i in range(len(p)):
            if a[i]:
                out.append(p[i])
            if a[i] != b[i]:
                t = (edge - p[i, axis]) / (q[i, axis] - p[i, axis])
                out.append(p[i] + t * (q[i] - p[i]))
        p = np.array(out).reshape(-1, 2)
    return p


def clip_line(p: np.ndarray) -> list[np.ndarray]:
    """GEO-30: the stretches of a line within the buffered tile."""
    out, now = [], []
    for a, b in zip(p[:-1], p[1:], strict=True):
        t0, t1, d = 0.0, 1.0, b - a
        for axis in (0, 1):
            for edge, sign in ((LOW, -1.0), (HIGH, 1.0)):
                slope, room = sign * d[axis], sign * (edge - a[axis])
                if slope == 0:
                    if room < 0:
                        t0, t1 = 1.0, 0.0
                elif slope < 0:
                    t0 = max(t0, room / slope)
                else:
                    t1 = min(t1, room / slope)
        if t0 > t1:
            if now:
                out.append(np.array(now))
            now = []
            continue
        start, stop = a + t0 * d, a + t1 * d
        if not now or t0 > 0:
            if now:
                out.append(np.array(now))
            now = [start]
        now.append(stop)
        if t1 < 1:
            out.append(np.array(now))
            now = []
    if now:
        out.append(np.array(now))
    return out


def pixels(p: np.ndarray) -> list[tuple[int, int]]:
    q = [(int(a), int(b)) for a, b in round_up(p)]
    return [v for i, v in enumerate(q) if not i or q[i - 1] != v]


class Commands:
    """GEO-32: geometry commands; the cursor carries on across parts."""

    def __init__(self) -> None:
        self.out: list[int] = []
        self.at = (0, 0)

    def move(self, points: Sequence[tuple[int, int]], command: int) -> None:
        self.out.append(len(points) << 3 | command)
        for x, y in points:
            self.out += [zigzag(x - self.at[0]), zigzag(y - self.at[1])]
            self.at = (x, y)

    def path(self, points: Sequence[tuple[int, int]], close: bool) -> None:
        self.move(points[:1], 1)
        self.move(points[1:], 2)
        if close:
            self.out.append(15)


def geometry_commands(g: Geometry, z: int, x: int, y: int) -> list[int]:
    c = Commands()
    if g.kind == 0:
        pts = [p for part in g.parts for p in pixels(project(part[0], z, x, y)) if LOW <= p[0] <= HIGH and LOW <= p[1] <= HIGH]
        if pts:
            c.move(pts, 1)
        return c.out
    for part in g.parts:
        if g.kind == 1:
            for piece in clip_line(project(part[0], z, x, y)):
                if len(line := pixels(piece)) >= 2:
                    c.path(line, False)
            continue
        for i, r in enumerate(part):
            p = project(r, z, x, y)
            if len(p) and (p[:, 0].max() < LOW or p[:, 0].min() > HIGH or p[:, 1].max() < LOW or p[:, 1].min() > HIGH):
                if i == 0:
                    break
                continue
            ring = pixels(clip_ring(p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p))
            if len(ring) > 1 and ring[0] == ring[-1]:
                ring.pop()
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) if len(ring) >= 3 else 0
            if not area:
                if i == 0:
                    break
                continue
            c.path(ring if (area > 0) == (i == 0) else ring[::-1], True)
    return c.out


def text(v) -> str:
    """GEO-37/H8: display strings of property values."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e21 else repr(v) if math.isfinite(v) else ("NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity")
    if isinstance(v, bytes):
        return f"<bytes:{len(v)}>"
    if hasattr(v, "isoformat"):
        iso = v.isoformat(timespec="milliseconds") if hasattr(v, "hour") else f"{v.isoformat()}T00:00:00.000"
        return iso.split("+")[0] + "Z"
    return v if isinstance(v, str) else str(v) if isinstance(v, int) else __import__("json").dumps(v, default=str, separators=(",", ":"))


class Layer:
    """GEO-33/SNK-15: one layer, feature by feature; only its encoded features and its distinct values are held."""

    def __init__(self, name: str, z: int, x: int, y: int) -> None:
        self.at, self.keys, self.values = (z, x, y), {}, {}
        self.body = bytearray(field(15, 0, varint(2)) + field(1, 2, name.encode()))

    def add(self, fid: int | None, g: Geometry, props: dict) -> None:
        """Features without commands are left out."""
        commands = geometry_commands(g, *self.at)
        if not commands:
            return
        tags = [i for k, v in props.items() for i in (self.keys.setdefault(k, len(self.keys)), self.values.setdefault(text(v), len(self.values)))]
        f = field(1, 0, varint(fid)) if fid is not None else b""
        if tags:
            f += field(2, 2, b"".join(map(varint, tags)))
        f += field(3, 0, varint(g.kind + 1)) + field(4, 2, b"".join(map(varint, commands)))
        self.body += field(2, 2, f)

    def add_points(self, fids: Sequence[int | None], xy: np.ndarray, props: dict[str, Sequence]) -> None:
        """As ``add`` of features of one point each."""
        z, x, y = self.at
        kept, names = pixels_each(xy, z, x, y).tolist(), list(props)
        for fid, (a, b), *own in zip(fids, kept, *props.values(), strict=True):
            if not (LOW <= a <= HIGH and LOW <= b <= HIGH):
                continue
            tags = [i for k, v in zip(names, own, strict=True) for i in (self.keys.setdefault(k, len(self.keys)), self.values.setdefault(text(v), len(self.values)))]
            f = b"\x08" + varint(fid) if fid is not None else b""
            if tags:
                f += field(2, 2, b"".join(map(varint, tags)))
            f += b"\x18\x01" + field(4, 2, b"\x09" + varint(zigzag(int(a))) + varint(zigzag(int(b))))
            self.body += field(2, 2, f)

    def tile(self) -> bytes:
        """An empty layer is still one."""
        self.body += b"".join(field(3, 2, k.encode()) for k in self.keys)
        self.body += b"".join(field(4, 2, field(1, 2, v.encode())) for v in self.values)
        self.body += field(5, 0, varint(EXTENT))
        return b"".join((varint(3 << 3 | 2), varint(len(self.body)), self.body))


def layer(name: str, features: Iterable[tuple[int | None, Geometry, dict]], z: int, x: int, y: int) -> bytes:
    out = Layer(name, z, x, y)
    for f in features:
        out.add(*f)
    return out.tile()


def decode(tile: bytes) -> dict[str, dict]:
    """A small reader, for tests and inspection: layer name to features, keys, values and extent."""
    def fields(b: bytes):
        at = 0
        while at < len(b):
            tag, at = number(b, at)
            if tag & 7 == 0:
                v, at = number(b, at)
            elif tag & 7 == 2:
                n, at = number(b, at)
                v, at = b[at : at + n], at + n
            else:
                v, at = struct.unpack_from("<d", b, at)[0], at + 8
            yield tag >> 3, v

    def number(b: bytes, at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (b[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if b[at - 1] < 128:
                return n, at

    def numbers(b: bytes) -> list[int]:
        out, at = [], 0
        while at < len(b):
            v, at = number(b, at)
            out.append(v)
        return out

    out = {}
    for _, body in fields(tile):
        one: dict = {"features": [], "keys": [], "values": []}
        for k, v in fields(body):
            if k == 1:
                name = v.decode()
            elif k == 2:
                f = dict(fields(v))
                one["features"].append({"id": f.get(1), "tags": numbers(f.get(2, b"")), "type": f[3], "geometry": numbers(f[4])})
            elif k == 3:
                one["keys"].append(v.decode())
            elif k == 4:
                one["values"].append(dict(fields(v))[1].decode())
            elif k == 5:
                one["extent"] = v
        out[name] = one
    return out
