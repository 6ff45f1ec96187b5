"""Lidar tables over the driver's tables, as common table expressions that both engines read.

A pulse is a line item: the order is its sweep, the line its track. Its id is a hash of the whole row, which needs no
ordering of the table. Missing heights are NULL, as everywhere in the engine.
"""

from __future__ import annotations

import re

from pulsegrid.plans.dialect import Dialect

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def tables(d: Dialect) -> dict[str, str]:
    key = " || '|' || ".join(d.text(x) for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "CAST(l_quantity AS BIGINT)", "CAST(round(l_extendedprice * 100) AS BIGINT)", "CAST(round(l_discount * 100) AS BIGINT)", "CAST(round(l_tax * 100) AS BIGINT)", "l_returnflag", "l_linestatus", d.epoch("l_shipdate")))
    return {
        "pulses": f"""
            SELECT *, CASE WHEN track_num = 7 AND tax > 75e-3 THEN NULL
                ELSE ground + CASE WHEN qty > 45 THEN amp / 4 WHEN discount > 95e-3 AND qty < 4 THEN -8 - amp / 2 WHEN qty > 40 THEN 1 + tax * 20 ELSE tax * 5 END END AS refh,
                -869e-1 + x * 1e-5 AS lon, 404e-1 + y * 1e-5 AS lat, (amp - bg_mean) / bg_std AS snr_bg, bg_mean + 3 * bg_std AS thres
            FROM (SELECT {d.hex_id(key)} AS pulse_index, l_orderkey AS sweep_num, CAST(l_linenumber AS BIGINT) AS track_num, l_extendedprice / 1000 AS amp, l_quantity / 5 AS snr, l_quantity AS qty,
                l_discount AS discount, l_tax AS tax, 1 + l_discount * 10 AS bg_mean, 5e-1 + l_tax * 10 AS bg_std, l_partkey * 1e-1 AS x, l_suppkey * 2e0 + l_linenumber * 25e-2 AS y,
                40 + l_partkey * 1e-3 + l_suppkey * 1e-2 AS ground, {d.epoch('l_shipdate')} AS delta_time, l_returnflag AS roi, l_linestatus AS granule,
                CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 7 END AS ref_class FROM lineitem) AS raw_pulses""",
        "good": "SELECT * FROM pulses WHERE refh IS NOT NULL AND snr >= 1e0 AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90",
        "waves": "SELECT vec_id AS pulse_index, CAST(label AS BIGINT) AS track_num, embedding AS rx FROM embeddings",
        # waveforms with gaps, a background (unknown for some) and the signal of their scene
        "gapped": f"""SELECT vec_id AS pulse_index, CAST(label AS BIGINT) AS track_num, vec_id AS sweep_num, {d.transform('embedding', 'v', 'CASE WHEN abs(v) < 4e-3 THEN NULL ELSE CAST(v AS DOUBLE) END')} AS rx, (vec_id % 5) * 1e-2 - 2e-2 AS bg_mean,
            CASE WHEN vec_id % 50 <> 0 THEN 5e-2 + (vec_id % 3) * 1e-2 END AS bg_std, 2e-2 AS thres, 1e0 + vec_id % 9 AS snr, 40 + label * 2e0 + (vec_id % 17) * 3e-1 AS refh FROM embeddings""",
        "bins": d.pick("SELECT pulse_index, track_num, CAST(pos AS BIGINT) AS bin, CAST(v AS DOUBLE) AS v FROM waves LATERAL VIEW posexplode(rx) AS pos, v", "SELECT pulse_index, track_num, CAST(i - 1 AS BIGINT) AS bin, CAST(rx[i] AS DOUBLE) AS v FROM waves, unnest(generate_series(1, len(rx))) AS t(i)"),
        "refs": "SELECT p_partkey AS ref_id, p_partkey * 1e-1 AS x, (p_size * 37 + p_partkey) % 200 * 1e0 AS y, 40 + p_partkey * 1e-3 + p_retailprice / 1e4 AS z, CASE WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 7 = 0 THEN 7 ELSE 2 END AS class, p_brand AS tile FROM part",
        "stations": "SELECT s_suppkey AS station_id, s_suppkey * 2e0 AS x, (s_suppkey * 7919) % 200 * 1e0 AS y, 40 + s_suppkey * 2e-3 AS z, CAST(s_nationkey AS BIGINT) AS site FROM supplier",
        "residuals": "SELECT pulse_index, sweep_num, track_num, roi, granule, snr, x, y, refh - ground AS r, amp FROM pulses WHERE refh IS NOT NULL",
        "truth": "SELECT l.doc_id, CASE WHEN l.quality = 0 THEN 7 WHEN l.toxic = 1 THEN 1 ELSE 2 END AS t, CASE WHEN d.n_chars % 11 = 0 THEN 1 WHEN l.quality = 0 OR d.n_chars < 300 THEN 7 ELSE 2 END AS p, d.source, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    }


def with_tables(d: Dialect, body: str) -> str:
    """body preceded by the tables that it, and they in turn, name."""
    known = tables(d)
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                need(known[name])
                if name not in wanted:
                    wanted.append(name)

    need(body)
    head = ",\n".join(f"{name} AS ({known[name]})" for name in wanted)
    text = body.strip()
    if head:
        text = f"WITH {head},\n{text[4:].strip()}" if text.upper().startswith("WITH") else f"WITH {head}\n{text}"
    return text


def for_spark(text: str) -> tuple[str, list[str]]:
    """Text with the driver's tables as placeholders, and those tables."""
    used = []

    def mark(m: re.Match) -> str:
        used.append(m[2])
        return f"{m[1]}{{{m[2]}}}"

    return re.sub(rf"(\b(?:FROM|JOIN)\s+)({'|'.join(SOURCES)})\b", mark, text), sorted(set(used))
