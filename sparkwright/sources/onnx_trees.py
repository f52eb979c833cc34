"""Tree ensembles in ONNX files: the node arrays read from the file's bytes and written to them.

A file is protocol-buffer messages, of which only these fields matter (fixed values of the format): model.graph 7,
graph.node 1, .input 11, .output 12, node.input 1, .output 2, .op_type 4, .attribute 5, .domain 7, attribute.name 1,
.f 2, .i 3, .s 4, .floats 7, .ints 8, .strings 9, .type 20.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from sparkwright.plans.ensembles import Ensemble, Tree

REGRESSOR, CLASSIFIER = "TreeEnsembleRegressor", "TreeEnsembleClassifier"
MODES = {"BRANCH_LEQ": "<=", "BRANCH_LT": "<", "BRANCH_GTE": ">=", "BRANCH_GT": ">", "BRANCH_EQ": "=", "BRANCH_NEQ": "<>"}


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value - (1 << 64) if value >> 63 else value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message; fixed-width ones as bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            size, at = varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("the file ends within a field")
        yield key >> 3, value


def numbers(values: list, code: str | None) -> list:
    """A repeated field's numbers, packed or not; ``code`` is struct's, none for integers."""
    out: list = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
        elif code:
            out.extend(struct.unpack(f"<{len(v) // struct.calcsize(code)}{code}", v))
        else:
            at = 0
            while at < len(v):
                value, at = varint(v, at)
                out.append(value)
    return out


def message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def attribute(data: bytes) -> tuple[str, object]:
    m = message(data)
    name = m[1][0].decode()
    for number, code in ((7, "f"), (8, None), (2, "f"), (3, None)):
        if number in m:
            values = numbers(m[number], code)
            return name, values if number in (7, 8) else values[0]
    return name, [v.decode() for v in m.get(9, [])] if 9 in m or 4 not in m else m[4][0].decode()


def ensemble(data: bytes) -> Ensemble:
    """The one tree ensemble of an ONNX file; other nodes (casts, reshapes of the result) are passed over."""
    graph = message(message(data)[7][0])
    nodes = [message(n) for n in graph.get(1, [])]
    found = [n for n in nodes if n.get(4, [b""])[0].decode() in (REGRESSOR, CLASSIFIER)]
    if len(found) != 1:
        raise ValueError(f"expected one tree ensemble, found {len(found)}")
    classifier = found[0][4][0].decode() == CLASSIFIER
    a = dict(attribute(x) for x in found[0].get(5, []))
    prefix = "class" if classifier else "target"
    tree_ids, node_ids, modes = a["nodes_treeids"], a["nodes_nodeids"], a["nodes_modes"]
    places = {key: i for i, key in enumerate(zip(tree_ids, node_ids, strict=True))}
    odd = set(modes) - {"LEAF", *MODES}
    if odd:
        raise ValueError(f"modes that are not known: {sorted(odd)}")
    targets = max(a[f"{prefix}_ids"], default=0) + 1
    weights: dict[int, list[float]] = {}
    for t, n, target, w in zip(a[f"{prefix}_treeids"], a[f"{prefix}_nodeids"], a[f"{prefix}_ids"], a[f"{prefix}_weights"], strict=True):
        weights.setdefault(places[t, n], [0.0] * targets)[target] += w
    missing = a.get("nodes_missing_value_tracks_true") or [0] * len(modes)
    tree = Tree([], [], [], [], [], [], [])
    for i, mode in enumerate(modes):
        leaf = mode == "LEAF"
        yes, no = (-1, -1) if leaf else (places[tree_ids[i], a["nodes_truenodeids"][i]], places[tree_ids[i], a["nodes_falsenodeids"][i]])
        tree.add(a["nodes_featureids"][i], a["nodes_values"][i], MODES.get(mode, "<="), yes, no, bool(missing[i]), weights.get(i, [0.0] * targets) if leaf else [0.0] * targets)
    inner = {n for i in range(len(modes)) if modes[i] != "LEAF" for n in (tree.yes[i], tree.no[i])}
    base = a.get("base_values") or []
    transform = a.get("post_transform", "NONE")
    if transform not in ("NONE", "LOGISTIC", "SOFTMAX"):
        raise ValueError(f"transform that is not known: {transform}")
    if classifier and targets == 1 and transform == "NONE":
        transform = "BINARY"  # the one weight is the chance of the second class
    return Ensemble(tree, [i for i in range(len(modes)) if i not in inner], base or [0.0] * targets, transform, a.get("aggregate_function", "SUM") == "AVERAGE", single=True)


def coded(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def field(number: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return coded(number << 3) + coded(value)
    value = value.encode() if isinstance(value, str) else value
    return coded(number << 3 | 2) + coded(len(value)) + value


def written_attribute(name: str, value: object) -> bytes:
    """A list of floats, integers or strings, or one string."""
    if isinstance(value, str):
        return field(5, field(1, name) + field(4, value) + field(20, 3))
    if value and isinstance(value[0], str):
        return field(5, field(1, name) + b"".join(field(9, v) for v in value) + field(20, 8))
    if value and isinstance(value[0], float):
        return field(5, field(1, name) + field(7, struct.pack(f"<{len(value)}f", *value)) + field(20, 6))
    return field(5, field(1, name) + field(8, b"".join(coded(v) for v in value)) + field(20, 7))


def onnx_bytes(model: Ensemble, features: int) -> bytes:
    """The regressor of ``model``'s trees, one output column a target, as an ONNX file: float input ``features``.

    Weights and thresholds become 32-bit floats; a threshold is rounded down, so that floats on either side of it stay there.
    """
    t, owner = model.trees, model.owners()
    targets, leaves = len(model.base), [i for i in range(len(owner)) if model.trees.yes[i] < 0]
    symbols = {v: k for k, v in MODES.items()}
    entries = [(i, k) for i in leaves for k in range(targets)]
    attributes = {
        "nodes_treeids": owner, "nodes_nodeids": list(range(len(owner))), "nodes_featureids": t.feature, "nodes_values": [float_below(v) for v in t.threshold],
        "nodes_modes": ["LEAF" if t.yes[i] < 0 else symbols[t.mode[i]] for i in range(len(owner))],
        "nodes_truenodeids": [max(0, x) for x in t.yes], "nodes_falsenodeids": [max(0, x) for x in t.no], "nodes_missing_value_tracks_true": [int(x) for x in t.missing],
        "target_treeids": [owner[i] for i, _ in entries], "target_nodeids": [i for i, _ in entries], "target_ids": [k for _, k in entries], "target_weights": [float(t.weight[i][k]) for i, k in entries],
        "base_values": [float(b) for b in model.base], "post_transform": model.transform, "aggregate_function": "AVERAGE" if model.mean else "SUM",
    }
    node = field(1, "features") + field(2, "variable") + field(4, REGRESSOR) + b"".join(written_attribute(k, v) for k, v in attributes.items()) + written_target_count(targets) + field(7, "ai.onnx.ml")

    def value_info(name: str, columns: int) -> bytes:
        shape = field(1, field(2, "batch")) + field(1, field(1, columns))
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))

    graph = field(1, node) + field(2, "trees") + field(11, value_info("features", features)) + field(12, value_info("variable", targets))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 18)) + field(8, field(1, "ai.onnx.ml") + field(2, 3))


def written_target_count(targets: int) -> bytes:
    return field(5, field(1, "n_targets") + field(3, targets) + field(20, 2))


def float_below(x: float) -> float:
    """The largest 32-bit float that is at most ``x``."""
    y = struct.unpack("<f", struct.pack("<f", x))[0]
    if y <= x:
        return y
    bits = struct.unpack("<i", struct.pack("<f", y))[0]
    return struct.unpack("<f", struct.pack("<i", bits - 1 if y > 0 else bits + 1 if y < 0 else -(1 << 31) + 1))[0]
