"""Where the partitions of a new batch go: racks to groups, and partitions to nodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def assign_racks(racks: Sequence[str], groups: Sequence[str], linked: Mapping[str, str] | None = None, owners: Mapping[str, str] | None = None) -> dict[str, str]:
    """Rack -> group. Each rack goes to the group with the fewest racks so far, but to one linked to a group that owns the rack in `owners`, if there is one."""
    linked, owners = linked or {}, owners or {}
    held = {g: 0 for g in groups}
    out = {}
    for rack in racks:
        follow = [g for g in groups if g in linked and owners.get(rack) == linked[g]]
        group = min(follow or groups, key=lambda g: (held[g], groups.index(g)))
        held[group] += 1
        out[rack] = group
    return out


def place(ranges: int, schemes: Sequence[str], nodes: Sequence[str], load: Mapping[str, int] | None = None, beside: Mapping[tuple[str, int], str] | None = None) -> dict[tuple[str, int], str]:
    """(scheme, range) -> node.

    A range goes to the node of the same range in a linked replica (`beside`: (scheme, range) -> node), one scheme after the
    other; else to the node with the least load that holds no replica of the range; else to the one with the least.
    """
    load = {n: (load or {}).get(n, 0) for n in nodes}
    other = sorted({s for s, _ in beside}) if beside else []
    out: dict[tuple[str, int], str] = {}
    for i, scheme in enumerate(schemes):
        for r in range(ranges):
            node = beside.get((other[i % len(other)], r)) if other else None
            if node is None:
                taken = {out[s, r] for s in schemes[:i]}
                free = [n for n in nodes if n not in taken] or list(nodes)
                node = min(free, key=lambda n: (load[n], nodes.index(n)))
            out[scheme, r] = node
            load[node] = load.get(node, 0) + 1
    return out
