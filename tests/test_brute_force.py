"""Queries that SQL cannot express, against plain Python over the smallest tables."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import __spark_entry__ as entry
from jobweave.functions import titles as T
from jobweave.operators import documents as D
from jobweave.operators import reports as R
from jobweave.operators.multivalue import split_values


def query(spark, folder, name):
    return entry.queries()[name](spark, folder).collect()


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet").collect()


def test_holdout_by_crc32(spark, folder):
    ids = [r["id"] for r in read(spark, folder, "dataset_job_raw") if r["posting_year"] == 2026]
    want = sorted(ids, key=lambda i: (zlib.crc32(f"{i}:20260101".encode()), i))[:100]
    assert {r["raw_id"] for r in query(spark, folder, "holdout_crc32")} == set(want) and want


def test_mentions_by_aliases(spark, folder):
    skills = read(spark, folder, "skill")
    names = [(r["id"], r["canonical_name"], 0) for r in skills]
    aliases = split_values(spark.read.parquet(f"{folder}/skill.parquet"), "id", "aliases").collect()
    names += [(r["row_id"], r["item_value"], r["item_pos"]) for r in aliases]
    usable = [(i, n.strip(" ").lower(), k) for i, n, k in names if n and len(n.strip(" ")) >= 2 and not re.fullmatch("[a-z0-9]{1,2}", n.strip(" ").lower())]
    want = set()
    for d in read(spark, folder, "documents"):
        text, best = (d["text"] or "").lower(), {}
        for i, n, k in usable:
            if n in text and (i not in best or (k, n) < best[i]):
                best[i] = (k, n)
        want |= {(d["doc_id"], i, text.index(n) + 1) for i, (_, n) in best.items()}
    assert {(r["doc_id"], r["skill_id"], r["place"]) for r in query(spark, folder, "alias_mentions")} == want and want


def clean(title):
    text = re.sub(r"[\r\n\t]+", " ", unicodedata.normalize("NFKC", title or ""))
    for pattern in (T.PAY_RANGE, T.SHORT_BRACKETS, T.NOISE):
        text = re.sub(pattern.replace("(?i)", ""), " ", text, flags=re.I)
    text = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip("".join(map(chr, range(33))))
    m = re.fullmatch(f"(.*?) *{T.DASH} *([^-—_]*)", text)
    m = re.fullmatch(f"(.*){T.DASH}([^-—_]*)", text) if m else None
    if m:
        head, tail = m.group(1).rstrip(" "), m.group(2).lstrip(" ")
        lead = next((r for r in T.LEADING_ROLES if head.endswith(r)), None)
        if lead and 2 <= len(head) - len(lead) <= 24 and re.fullmatch("[㐀-䶿一-鿿豈-﫿A-Za-z0-9]{2,12}", tail):
            text = f"{head}（{tail}方向）"
    return re.sub(T.EDGES.replace(r"\s", r" \t\n\x0b\f\r"), "", text).strip("".join(map(chr, range(33))))


def plausible(text):
    parts = re.split(r"[,，、/|丨]+", text)
    core = re.sub("(?:专员|人员|岗位)$", "", re.sub("^居家", "", text))
    return 2 <= len(text) <= 36 and core not in T.LOW_VALUE and not (len(parts) > 1 and sum(bool(re.search(T.ROLE_WORD, p)) for p in parts) > 1) and bool(re.search(T.ROLE_WORD, text))


def test_discovery_titles(spark, folder):
    want = {r["id"]: (clean(r["title"]), plausible(clean(r["title"]))) for r in read(spark, folder, "dataset_job_raw")}
    got = {r["id"]: (r["cleaned"], r["plausible"]) for r in query(spark, folder, "discovery_titles")}
    assert got == want and {v[1] for v in want.values()} == {True, False}
    assert {r["id"]: r["title"] for r in query(spark, folder, "presented_candidates")} == {k: v[0] for k, v in want.items() if v[1]}


def duty_sentences(text):
    for part in re.split(r"[。；;\n]|(?=[0-9一二三四五六七八九十]{1,2}[、.．)）])", text or ""):
        s = re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(D.BULLETS.replace(r"\s", r" \t\n\x0b\f\r"), "", part.strip("".join(map(chr, range(33)))))).strip(" ")
        for _ in range(D.ROUNDS):
            s = re.sub(rf"^[ ,，、;；]*(?:第?[{D.NUMERALS}]+(?:[、.．)）:：-]| +))+", "", s).strip(" ")
            s = re.sub(rf"^(?:{'|'.join(sorted(D.DUTY_LABELS, key=len, reverse=True))}) *[:：]", "", s).strip(" ")
        s = re.sub(r"^[,，、;；:： ]+", "", s).strip(" ")[:90]
        if len(s) >= 8 and not re.match("|".join(D.NOT_DUTY_FIRST), s) and not re.search("|".join(D.NOT_DUTY_ANYWHERE), s) and re.search(D.DUTY.replace("(?i)", ""), s, re.I):
            yield s


def test_frequent_duties(spark, folder):
    counts = Counter()
    for r in read(spark, folder, "zhitu_governed_job"):
        title = (r["title_standard"] or "").strip(" ")
        if title:
            counts.update((title, s) for s in duty_sentences(r["description_clean"]))
    want = set()
    for title in {t for t, _ in counts}:
        ranked = sorted(((s, n) for (t, s), n in counts.items() if t == title), key=lambda x: (-x[1], len(x[0]), x[0]))[:4]
        want |= {(title, s, n, k + 1) for k, (s, n) in enumerate(ranked)}
    assert {tuple(r) for r in query(spark, folder, "frequent_duties")} == want and want


def test_positions_and_copies(spark):
    df = spark.createDataFrame([(k * 7 % 101, f"word{k % 10} data{k % 10}") for k in range(101)], "id long, t string")
    assert {r["id"]: r["position"] for r in R.positions(df, "id", 5).collect()} == {k: k + 1 for k in range(101)}
    rows = sorted((k * 7 % 101, k % 10) for k in range(101))
    want = {}
    for p, (i, w) in enumerate(rows):
        earlier = [rows[j][0] for j in range(max(0, p - 9), p) if rows[j][1] == w]
        if earlier:
            want[i] = earlier[-1]
    assert {r["id"]: r["copy_of"] for r in R.recent_copies(df, "id", "t", back=9, parts=3).collect()} == want
    assert R.recent_copies(df.limit(0), "id", "t").count() == 0
    assert R.recent_copies(spark.createDataFrame([(1, None), (2, "")], "id long, t string"), "id", "t").count() == 0
