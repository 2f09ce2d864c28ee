"""Plain-Python versions of the operators, one row at a time, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo


def score(text):
    if text is None:
        return None
    text = text.strip()
    if text == "bootstrap":
        return -(10**18)
    if m := re.fullmatch(r"0/BOOTSTRAP(\d+)", text):
        return int(m[1]) - 1_000_000
    if m := re.search(r"bin\.(\d+):(\d+)$", text):
        return int(m[1]) * 2**32 + int(m[2])
    if m := re.fullmatch(r"([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})", text):
        return int(m[1], 16) * 2**32 + int(m[2], 16)
    return None


def value(cell):
    if cell is None:
        return None
    for k in ("string_value", "int_value", "float_value", "bool_value", "timestamp_value"):
        if cell[k] is not None:
            return str(cell[k])
    return None


def surplus(log):
    groups = defaultdict(list)
    for r in log:
        s = score(r["change_position"])
        if s is not None and r["stream_id"] is not None and r["row_no"] is not None:
            groups[r["stream_id"], s, r["row_no"]].append((r["received_at"], r["delivery_id"]))
    return {d for g in groups.values() for _, d in sorted(g)[1:]}


def key(table, names, values, fallback=None):
    cells = {**(fallback or {}), **dict(reversed(list(zip(names, map(value, values)))))}
    wanted = ("org_id", "user_id") if table.removeprefix("public.") == "user_roles" else ("id",)
    parts = [cells.get(c) for c in wanted]
    return None if None in parts else "|".join(parts)


def replay(log):
    """Cells (stream, table, key, column) -> score of the rows live at the end."""
    gone = surplus(log)
    live = {}
    kept = [r for r in log if r["delivery_id"] not in gone and score(r["change_position"]) is not None]
    for r in sorted(kept, key=lambda r: (r["stream_id"], score(r["change_position"]), r["row_no"])):
        names, values = r["column_names"] or [], r["column_values"] or []
        old_names, old_values = r["old_key_names"] or [], r["old_key_values"] or []
        kind, s, at = r["dml_kind"], score(r["change_position"]), (r["stream_id"], r["dml_table"])
        if kind not in ("insert", "update", "delete") or len(names) != len(values) or len(old_names) != len(old_values):
            continue
        if kind == "insert":
            k = key(r["dml_table"], names, values)
            if k is not None and (*at, k) not in live:
                live[*at, k] = {n: s for n in names}
            continue
        if not old_names:
            continue
        k = key(r["dml_table"], old_names, old_values)
        if (*at, k) not in live:
            continue
        if kind == "delete":
            del live[*at, k]
            continue
        new = key(r["dml_table"], names, values, dict(zip(old_names, map(value, old_values))))
        if new is not None and new != k:
            if (*at, new) in live:
                continue
            live[*at, new] = live.pop((*at, k))
            k = new
        live[*at, k].update({n: s for n in names})
    return {(*k, n): s for k, cells in live.items() for n, s in cells.items()}


_ZONES = {"UTC": 0, "GMT": 0, "Z": 0}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def instant(text, zone, dmy):
    """Microseconds since 1970 or None, by one regular expression after the other."""
    if text is None:
        return None
    text = text.strip()
    if re.fullmatch(r"\d{9,19}", text):
        for unit in (10**6, 1000, 1):
            us = int(text) * unit
            if datetime(2023, 1, 1) <= datetime(1970, 1, 1) + timedelta(microseconds=min(us, 4 * 10**15)) < datetime(2027, 1, 1):
                return us
        if len(text) == 19:
            return int(text) // 1000 if 2023 <= (datetime(1970, 1, 1) + timedelta(microseconds=int(text) // 1000)).year <= 2026 else None
        return None
    clock = r"(\d\d?):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?"
    rest = r"\s*(Z|z|[A-Za-z]{2,5}|[+-]\d\d:?\d\d|[+-]\d\d)?(?:\s+\S+)?(?:\[[^\]]*\])?"
    if m := re.fullmatch(rf"(\d{{4}})-(\d\d)-(\d\d)(?:[Tt ]{clock}{rest})?", text):
        y, mo, d, h, mi, s, f, z = m.groups()
    elif m := re.fullmatch(rf"(\d{{4}})(\d\d)(\d\d)[Tt](\d\d)(\d\d)(\d\d)(){rest}", text):
        y, mo, d, h, mi, s, f, z = m.groups()
    elif m := re.fullmatch(rf"(\d\d?)/(\d\d?)/(\d{{4}})(?: {clock})?(?: ?([AaPp][Mm]))?", text):
        a, b, y, h, mi, s, f, half = m.groups()
        d, mo, z = (a, b, None) if dmy else (b, a, None)
        if half:
            if not 1 <= int(h) <= 12:
                return None
            h = int(h) % 12 + (12 if half.lower() == "pm" else 0)
    elif m := re.fullmatch(rf"(?:[A-Za-z]{{3}}, ?)?(\d\d?) ([A-Za-z]{{3}}) (\d{{4}}) {clock}{rest}", text):
        d, name, y, h, mi, s, f, z = m.groups()
        if name.lower() not in _MONTHS:
            return None
        mo = _MONTHS.index(name.lower()) + 1
    else:
        return None
    if int(y) < 2:
        return None
    try:
        wall = datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0))
    except ValueError:
        return None
    micros = int((f or "")[:6].ljust(6, "0"))
    here = ZoneInfo(zone)
    if z is None:
        # fold=0: the earlier of two instants, and the offset before a gap
        offset = wall.replace(tzinfo=here, fold=0).utcoffset()
    elif re.fullmatch(r"[A-Za-z]+", z):
        names = {}
        for day in range(0, 366 * 3, 7):
            t = (datetime(2023, 1, 1, tzinfo=timezone.utc) + timedelta(days=day)).astimezone(here)
            names[t.tzname()] = t.utcoffset()
        if z.upper() in names:
            offset = names[z.upper()]
        elif z.upper() in _ZONES:
            offset = timedelta()
        else:
            return None
    else:
        digits = z[1:].replace(":", "").ljust(4, "0")
        offset = timedelta(hours=int(digits[:2]), minutes=int(digits[2:])) * (-1 if z[0] == "-" else 1)
    return ((wall - datetime(1970, 1, 1) - offset) // timedelta(seconds=1)) * 10**6 + micros


def drift(files, statements, databases):
    """Changes of columns between consecutive files of each table, statement by statement."""
    seen = {}
    for r in files:
        k = (r["stream_id"], r["dml_table"])
        f = seen.setdefault(k, {}).setdefault(r["file_id"], {"score": score(r["first_position"]), "tags": {}})
        for n, v in zip(r["column_names"], r["column_values"]):
            tags = f["tags"].setdefault(n.lower(), set())
            for field, x in (v or {}).items():
                if x is not None and x not in ("", "<nil>"):
                    tags.add(field)
    moves = defaultdict(set)
    name = r'["`]?(\w+)["`]?'
    for s in statements:
        text = re.sub(r"/\*.*?\*/|--[^\n]*", " ", s["ddl_text"] or "", flags=re.S).strip().rstrip(";").strip()
        m = re.match(rf"(?is)alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?([\w\"`.]+)\s+(.*)$", text)
        if m:
            table = re.sub(r'["`]', "", m[1]).lower().removeprefix(databases[s["stream_id"]] + ".")
            moves[s["stream_id"], table].add((score(s["change_position"]), m[2]))
    out = set()
    for (stream, table), versions in seen.items():
        order = sorted(versions, key=lambda f: (versions[f]["score"], f))
        for a, b in zip(order, order[1:]):
            old, new = versions[a]["tags"], versions[b]["tags"]
            now = {c: c for c in old}  # original -> current
            for _, clauses in sorted(x for x in moves[stream, table.lower()] if versions[a]["score"] < x[0] < versions[b]["score"]):
                for clause in clauses.split(","):
                    clause = clause.strip()
                    m = re.match(rf"(?is)rename\s+(?:column\s+)?{name}\s+to\s+{name}$", clause) or re.match(rf"(?is)change\s+(?:column\s+)?{name}\s+{name}\s", clause)
                    d = re.match(rf"(?is)drop\s+(?:column\s+)?(?:if\s+exists\s+)?{name}", clause)
                    if m:
                        now = {o: m[2].lower() if c == m[1].lower() else c for o, c in now.items()}
                    elif d:
                        now = {o: c for o, c in now.items() if c != d[1].lower()}
            renamed = {o: c for o, c in now.items() if o != c and c in new}
            pairs = {**{c: c for c in old if c in new and c not in renamed and c not in renamed.values()}, **renamed}
            for o, c in pairs.items():
                if o != c:
                    out.add((stream, table, b, "renamed", o, c))
                if old[o] and new[c] and old[o] != new[c]:
                    out.add((stream, table, b, "retyped", o, c))
            out |= {(stream, table, b, "removed", o, "") for o in old if o not in pairs}
            out |= {(stream, table, b, "added", "", c) for c in new if c not in pairs.values()}
    return out
