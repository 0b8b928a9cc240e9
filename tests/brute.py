"""Plain Python versions of the general problems, written from their statements alone."""

from __future__ import annotations

import re
import zoneinfo
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def rows(folder: str, name: str) -> list[dict]:
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def instant(raw, zone, locale):
    """UTC microseconds or None."""
    if raw is None:
        return None
    s = raw.strip()
    if re.fullmatch(r"[0-9]+", s):
        n = int(s)
        return n if n > 10**14 else n * 1000 if n > 10**11 else n * 10**6
    if m := re.fullmatch(r"([0-9]+)\.([0-9]+)", s):
        return int(m[1]) * 10**6 + int(m[2][:6].ljust(6, "0"))
    zone_text = None
    if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)Z", s):
        y, mo, d, h, mi, sec = map(int, m.groups())
        frac, zone_text = "", "Z"
    else:
        m = re.search(r"(\d{1,2}):(\d\d)(?::(\d\d)(?:\.(\d+))?)?(?:\s*([AP])M\b)?", s)
        if not m:
            return None
        h, mi, sec, frac = int(m[1]), int(m[2]), int(m[3] or 0), m[4] or ""
        if m[5]:
            if not 1 <= h <= 12:
                return None
            h = h % 12 + (12 if m[5] == "P" else 0)
        head, tail = s[: m.start()].strip(), s[m.end() :].strip()
        head = re.sub(r"[Tt]$", "", head).strip()
        head = re.sub(r"^(mon|tue|wed|thu|fri|sat|sun)\w*,?\s+", "", head, flags=re.I)
        if year := re.search(r"(^|\s)(\d{4})$", tail):
            if re.fullmatch(r"[A-Za-z]{3,} +\d{1,2}", head):
                head, tail = head + " " + year[2], tail[: year.start()].strip()
        if p := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", head):
            y, mo, d = map(int, p.groups())
        elif p := re.fullmatch(r"(\d{1,2})[./](\d{1,2})[./](\d{4})", head):
            d, mo, y = map(int, p.groups())
            if (locale or "").endswith("-US"):
                d, mo = mo, d
        elif (p := re.fullmatch(r"(\d{1,2}) ([A-Za-z]{3})\w* (\d{4})", head)) and p[2].lower() in MONTHS:
            d, mo, y = int(p[1]), MONTHS.index(p[2].lower()) + 1, int(p[3])
        elif (p := re.fullmatch(r"([A-Za-z]{3})\w* +(\d{1,2}) (\d{4})", head)) and p[1].lower() in MONTHS:
            d, mo, y = int(p[2]), MONTHS.index(p[1].lower()) + 1, int(p[3])
        else:
            return None
        zone_text = tail or None
    try:
        local = datetime(y, mo, d, h, mi, sec)
    except ValueError:
        return None
    us = (local - datetime(1970, 1, 1)) // timedelta(microseconds=1) + int(frac[:6].ljust(6, "0"))
    if zone_text is None:
        tz = zoneinfo.ZoneInfo(zone or "UTC")
        utc = local.replace(tzinfo=tz, fold=0).astimezone(timezone.utc)
        if utc.astimezone(tz).replace(tzinfo=None) != local:
            return None
        return us - int(local.replace(tzinfo=tz, fold=0).utcoffset().total_seconds()) * 10**6
    if zone_text.upper() in ("Z", "UTC", "GMT"):
        return us
    if p := re.fullmatch(r"([+-])(\d\d):?(\d\d)", zone_text):
        return us - (1 if p[1] == "+" else -1) * (int(p[2]) * 60 + int(p[3])) * 60 * 10**6
    tz = zoneinfo.ZoneInfo(zone or "UTC")
    for month in range(1, 13):
        t = datetime(y, month, 15, tzinfo=tz)
        if t.tzname() == zone_text:
            return us - int(t.utcoffset().total_seconds()) * 10**6
    return None


def zones(folder):
    return {r["cloud_id"]: (r["time_zone"], r["date_locale"]) for r in rows(folder, "source_registry")}


def p7(folder):
    z = zones(folder)
    cloud = {m["manifest_id"]: m["cloud_id"] for m in rows(folder, "manifests")}
    out = set()
    exact = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ")
    values = [("manifests", m["manifest_id"], m["ts"], m["cloud_id"]) for m in rows(folder, "manifests")]
    values += [("manifest_files", f["entry_id"], f["mtime"], cloud[f["manifest_id"]]) for f in rows(folder, "manifest_files")]
    for t, i, raw, c in values:
        if raw is not None and not exact.fullmatch(raw) and (us := instant(raw, *z[c])) is not None:
            out.add((t, i, us))
    return out


def p2(folder):
    z, reach, files = zones(folder), {}, defaultdict(list)
    for r in rows(folder, "scan_runs"):
        if r["outcome"] == "ok":
            reach[r["cloud_id"]] = max(reach.get(r["cloud_id"], r["cutoff_at"]), r["cutoff_at"])
    for r in rows(folder, "files_scan"):
        if r["status"] not in ("locked", "error"):
            files[r["cloud_id"], r["rel_path"]].append(r)
    out = set()
    for (c, path), seen in files.items():
        what = lambda r: (r["size"], instant(r["mtime"], *z[c]))  # noqa: B023, E731
        before = [r for r in seen if c in reach and r["arrived_at"] <= reach[c]]
        if not before or what(max(seen, key=lambda r: r["rev"])) != what(max(before, key=lambda r: r["rev"])):
            out.add((c, path))
    return out


def _states(folder):
    """cloud -> (manifest ids in order, [path -> (hash, mtime instant)] in that order)."""
    z, order, at = zones(folder), defaultdict(dict), defaultdict(dict)
    for m in rows(folder, "manifests"):
        order[m["cloud_id"]][m["manifest_id"]] = (instant(m["ts"], *z[m["cloud_id"]]) or -(10**18), m["manifest_id"])
    for f in rows(folder, "manifest_files"):
        path = f["path"].replace("\\", "/").removeprefix("/")
        if path not in at[f["manifest_id"]] or at[f["manifest_id"]][path]["pos"] < f["pos"]:
            at[f["manifest_id"]][path] = f
    for c, ids in order.items():
        ids, known, out = sorted(ids, key=ids.get), {}, []
        for i in ids:
            state = {}
            for path, f in at[i].items():
                own = (f["content_hash"], instant(f["mtime"], *z[c]))
                if f["status"] in ("locked", "error"):
                    own = known.get(path, own)
                else:
                    known[path] = own
                state[path] = own
            out.append(state)
        yield c, ids, out


def p6(folder):
    out = set()
    for _, ids, states in _states(folder):
        for i, was, now in zip(ids[1:], states, states[1:]):
            out |= {(i, p, "added") for p in now.keys() - was.keys()} | {(i, p, "removed") for p in was.keys() - now.keys()}
            out |= {(i, p, "changed") for p in now.keys() & was.keys() if now[p][0] != was[p][0]}
    return out


def p3(folder):
    out = set()
    for c, ids, states in _states(folder):
        versions = defaultdict(list)
        for n, state in enumerate(states):
            for p, v in state.items():
                if versions[p] and versions[p][-1][1] == n and versions[p][-1][2] == v:
                    versions[p][-1][1] = n + 1
                else:
                    versions[p].append([n, n + 1, v])
        for p, vs in versions.items():
            if len(vs) > 1:
                out |= {(c, p, ids[a], ids[b] if b < len(ids) else 0) for a, b, _ in vs}
    return out
