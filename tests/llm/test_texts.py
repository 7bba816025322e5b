from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from jobweave.llm import abuse, packing, personal_data
from jobweave.llm.fm_index import FMIndex, suffix_array
from jobweave.llm.leaks import common_letters, common_tokens, find_leaks, removal_spans, shard_leaks, token_places, tokens_of
from jobweave.llm.personal_data import find_spans, personal_data_kinds, redact, redacted
from jobweave.llm.phrases import Phrases

FOUND = {
    "邮箱：mira60@rowan.example.org，谢谢": "邮箱：[EMAIL]，谢谢", "写信到 talent94 [at] kestrel [dot] example [dot] com 沟通": "写信到 [EMAIL] 沟通", "hr9(at)a.example. Next": "[EMAIL]. Next", "发到mira17＠post.ostel.example": "发到[EMAIL]",
    "联系电话：１４０００００１１３８。": "联系电话：[PHONE]。", "咨询请拨一七三五五五零零八八二": "咨询请拨[PHONE]", "加急可短信0948-55503547转53": "加急可短信[PHONE]", "Call +1 415 555 0126 on weekdays": "Call [PHONE] on weekdays", "Text (202) 555-0183 now": "Text [PHONE] now",
    "My name is John Carter.": "My name is [PERSON].", "please contact Maria Lopez": "please contact [PERSON]", "工程师张伟负责对接": "工程师[PERSON]负责对接", "Come to 21 Baker street, London": "Come to [ADDRESS]",
    "pay to GB82 WEST 1234 5698 7654 32 now": "pay to [ACCOUNT] now", "银行卡号 6222021234567890123": "银行卡号 [ACCOUNT]", "见 tel:010-62345678。": "见 tel:[PHONE]。", "mailto:a.b@c.example": "mailto:[EMAIL]", "白天打13900001111": "白天打[PHONE]", "到场后找濮阳汀芮报到": "到场后找[PERSON]报到",
    "13800009413": "[PHONE]", "身份证：992115199007236035": "身份证：[ID_NUMBER]", "证件号991526 19920125 3576请勿": "证件号[ID_NUMBER]请勿", "carries SSN 000-95-1169.": "carries SSN [ID_NUMBER].", "证件号码990715920904456": "证件号码[ID_NUMBER]",
    "面试请到沅岭市南屿区松涛路385弄34号": "面试请到[ADDRESS]", "集合地点在星岸大道36号澄观大厦C座22层": "集合地点在[ADDRESS]", "Meet us at 222 Copperfield Rise, Apt 5.": "Meet us at [ADDRESS].", "Post documents to 675 Old Lantern Avenue, Aldermoor.": "Post documents to [ADDRESS].",
    "联系人：濮阳汀芮": "联系人：[PERSON]", "面试官仉霁漪会提前一天与您确认": "面试官[PERSON]会提前一天与您确认", "由殳漪老师安排笔试": "由[PERSON]老师安排笔试", "Contact person: Quisling-Moor, Perrin.": "Contact person: [PERSON].", "report to I. Vasselby today": "report to [PERSON] today", "Ask for OSKARI GRAUWITZ at": "Ask for [PERSON] at",
}
NOTHING = (
    "pay to GB82 WEST 1234 5698 7654 33 now", "寻找工作。", "可找工作机会", "打通数据平台", "产品经理需求负责", "contact center staff", "Contact Platform Lead", "walk 12 Data way", "第 GB12 区",
    "流水号 9934311994234447225113X 仅作示例", "单表 2024221015749 行仍可分钟级返回", "日均处理 13900000327 条消息", "依赖 queue-core@2.18.12 及以上版本", "熟悉 @Timed 与 @Retry 注解的用法", "统一信用代码 991879MA7474X9738Q", "项目编号 PRJ-2020-9407-020",
    "巡检 12号仓与19号井之间的线路", "乘地铁9号线可达", "维护联系人：分组管理模块", "邮箱服务与短信电话网关的联调经验", "工作地点在朔浦市云溪区", "Serial 914-18-2009-K marks the test rig.", "Part 555-9716-B of the kit", "Ticket REF-2022-7198 explains", "Handles 13900766711 rows per day.",
    "Runs build 10.29.20.4 on site.", "Covers Dock 16 Street Lighting software.", "Adds phone and email channels to the portal.", "Maintains the contact person module.", "You will report to the Platform Lead", "At least 9 years around a scorecard", "", "一" * 10_000,
)


def test_check_digits():
    assert personal_data.iban_valid("DE89370400440532013000") and not personal_data.iban_valid("DE89370400440532013001")
    assert personal_data.card_valid("4111 1111 1111 1111") and not personal_data.card_valid("4111 1111 1111 1112")
    assert personal_data.id_valid("11010519491231002X") and not personal_data.id_valid("110105194912310021")


@pytest.mark.parametrize("text", FOUND)
def test_found(text):
    assert redact(text) == FOUND[text]
    assert redact(f"​{text}") == f"​{FOUND[text]}"


@pytest.mark.parametrize("text", NOTHING)
def test_nothing_found(text):
    assert find_spans(text) == []


BARE = {
    "周末也可 400-820-8820 咨询": "周末也可 [PHONE] 咨询", "8008201234": "[PHONE]", "400 8208 820。": "[PHONE]。", "前台 0571-12345678 转接": "前台 [PHONE] 转接", "010-12345678转53": "[PHONE]",
    "Reach us on weekdays: 415-555-0123.": "Reach us on weekdays: [PHONE].", "(415-555-0123)": "([PHONE])",
}
NO_PHONE = ("单表 4008201234 行", "编号 400-820-8820", "订单0571-12345678", "Part 415-555-0123", "PRJ-415-555-0123", "415-555-0123-7", "015-555-0123", "0571-12345678-9", "1400-820-8820", "9-0571-12345678", "4008201234 rows")


@pytest.mark.parametrize("text", BARE)
def test_bare_phones(text):
    assert redact(text) == BARE[text]


@pytest.mark.parametrize("text", NO_PHONE)
def test_no_phone(text):
    assert [k for _, _, k in find_spans(text) if k == "phone"] == []


def test_kinds(spark):
    df = spark.createDataFrame([(1, "a@b.example 13800009413 c@d.example", "k"), (2, None, "k"), (3, "", "k"), (None, "a@b.example", "k"), (4, "x" * 50_000 + " a@b.example", "k"), (4, "a@b.example", "k")], "id int, text string, pii_kind string")
    got = sorted((r["id"] or 0, r["pii_kind"]) for r in personal_data_kinds(df, "id", "text").collect())
    assert got == [(0, "email"), (1, "email"), (1, "phone"), (4, "email"), (4, "email")]
    assert personal_data_kinds(df.limit(0), "id", "text").count() == 0
    assert redacted(df, "text").where("id = 2").first()["redacted"] is None


def test_suffix_array_and_search():
    rng = np.random.default_rng(0)
    for n, letters in ((1, 1), (60, 2), (2000, 3), (2000, 60)):
        codes = rng.integers(1, letters + 1, n)
        text = np.r_[codes, 0]
        assert suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        index = FMIndex(codes)
        for length in (1, 2, 5):
            for at in rng.integers(0, max(1, n - length), 10):
                phrase = codes[at : at + length]
                if len(phrase) == length:
                    (low,), (high,) = index.search(phrase[None, :])
                    want = [i for i in range(n - length + 1) if (codes[i : i + length] == phrase).all()]
                    assert sorted(index.locate(np.arange(low, high)).tolist()) == want


ITEM = "审计员抽走25条血缘图记录复算；样本里9例来自弹性线路；样本里23例来自强监管线路；把链路追踪拆成可并行的1块，各配一名负责人？"
ENGLISH = "A trainee wired the training harness into the simulation sandbox. Charts of design records and cost models mirror each other. The sole clue is what the sandbox left among the handover notes."


def test_leaks(spark):
    other = "复盘时发现高噪声合同解析器的自动化测试缺口最大，需要优化排队时长。" * 30
    noisy = ITEM.replace("抽走", "带走").replace("弹性", "柔性").replace("，", " ").replace("追踪", "跟踪")
    half = ITEM[: int(len(ITEM) * 0.7)]
    rows = [
        (1, other + ITEM + other), (2, noisy), (3, "x" + half), (4, ITEM[:14] + other), (5, "".join(p + other for p in ITEM.split("；"))), (6, ENGLISH.upper().replace("the", "some", 1).replace("CHARTS", "\nPLOTS")), (7, None), (8, ""), (9, other), (10, ITEM), (10, ITEM),
        (11, ENGLISH[: len(ENGLISH) // 4] + other), (12, "Ｔｒａｉｎｅｅ"), (13, "ab" * 30_000),
    ]
    docs = spark.createDataFrame([(i, t, "i") for i, t in rows], "doc_id long, text string, item string")
    items = spark.createDataFrame([(70, ITEM), (71, ENGLISH), (72, None), (73, ""), (74, "？！")], "item_id long, text string")
    found = find_leaks(docs, items)
    assert sorted((r["doc"], r["item"]) for r in found.collect()) == [(1, 70), (2, 70), (3, 70), (6, 71), (10, 70), (10, 70)]
    span = found.where("doc = 1").first()
    assert rows[0][1][span["first"] : span["end"]] == ITEM[:-1]
    assert [tuple(s) for s in removal_spans(found).where("doc = 1").first()["spans"]] == [(span["first"], span["end"])]
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0
    assert common_tokens(tokens_of("a b c d"), tokens_of("b x d")) == 2
    assert common_letters(["a", "bcd", "ef"], ["bcd", "a", "ef"]) == 5 / 6
    for text in ("Ab，ｃ１ é e\u0301x ﬁ가 ㌔。", "审计 A1-b", ""):
        assert [tokens_of(text[a:b]) for a, b in token_places(text)] == [[t] for t in tokens_of(text)] or "ﬁ" in text


def test_an_item_leaked_twice(spark):
    other = "复盘时发现高噪声合同解析器的自动化测试缺口最大，需要优化排队时长。" * 10
    part = ITEM[: int(len(ITEM) * 0.7)]
    noisy = ITEM.replace("抽走", "带走").replace("弹性", "柔性")
    texts = {
        1: ["", ITEM, other, ITEM, other], 2: [other, part, other, noisy, other, ITEM, ""], 3: ["", ITEM, "", ITEM, ""], 4: [other, part, "", ITEM, "", noisy, other],
        5: [other, ENGLISH, f" {other} ", ENGLISH.upper(), other, ITEM, other], 6: [other, ITEM, other + ITEM[:12] + other],
    }
    docs = spark.createDataFrame([(i, "".join(t)) for i, t in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(70, ITEM), (71, ENGLISH)], "item_id long, text string")
    found = find_leaks(docs, items)
    assert sorted((r["doc"], r["item"]) for r in found.collect()) == [(1, 70)] * 2 + [(2, 70)] * 3 + [(3, 70)] * 2 + [(4, 70)] * 3 + [(5, 70)] + [(5, 71)] * 2 + [(6, 70)]
    spans = {r["doc"]: r["spans"] for r in removal_spans(found).collect()}
    for i, pieces in texts.items():
        at = 0
        for k, piece in enumerate(pieces):
            places = range(at, at := at + len(piece))
            cut = sum(len(range(max(places.start, a), min(places.stop, b))) for a, b in spans[i])
            # Of a passage no more than its ends stay, of the rest no more than a stretch goes.
            assert cut >= len(piece) - 3 if k % 2 else cut <= len(ENGLISH) // 2, (i, k)


def test_many_items_share_one_index(spark, monkeypatch):
    """100 000 items, all with the same opening, beside 80: the same leaks of the same items, and every block used."""
    rng = np.random.default_rng(5)
    words = lambda n: "".join(chr(0x4E00 + k) for k in rng.integers(0, 3000, n))
    few = [(k, "请先核对以下内容" + words(30)) for k in range(80)]
    filler = [(1000 + k, "请先核对以下内容" + words(24)) for k in range(100_000)]
    docs = [(1, words(50) + few[3][1] + words(50)), (2, "请先核对以下内容" + words(400)), (3, few[7][1][:30] + words(90)), (4, filler[99_999][1]), (5, "请先核对以下内容" * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    small = {(r["doc"], r["item"]) for r in find_leaks(df, spark.createDataFrame(few, "item_id long, text string")).collect()}
    assert small == {(1, 3), (3, 7)}
    items = spark.createDataFrame(pd.DataFrame(few + filler, columns=["item_id", "text"]))
    large = {(r["doc"], r["item"]) for r in find_leaks(df, items).collect()}
    assert {x for x in large if x[1] < 1000} == small and (4, 100_999) in large
    monkeypatch.setattr("jobweave.llm.leaks.EXPANDED", 1000)
    monkeypatch.setattr("jobweave.llm.leaks.FEW", 0)
    texts = [t for _, t in docs]
    block = [Phrases([i for i, _ in few], [tokens_of(t) for _, t in few]).ready()]
    got = {(d, i) for d, i, *_ in shard_leaks([i for i, _ in docs], texts, block, 0.5)}
    assert got == small


def slow_best_fit(sizes, capacity, most):
    bins, where, opened = [], [], 0
    for s in sizes:
        fitting = [b for b in bins if b[0] >= s]
        if fitting:
            b = min(fitting, key=lambda b: b[0])
        else:
            if len(bins) == most:
                bins.remove(min(bins, key=lambda b: b[0]))
            b = [capacity, opened]
            opened += 1
            bins.append(b)
        where.append(capacity - b[0])
        b[0] -= s
        if b[0] == 0:
            bins.remove(b)
    return where, opened


def test_best_fit_against_a_slow_one():
    rng = random.Random(2)
    for most in (1, 4, 16):
        sizes = [rng.randint(1, 50) for _ in range(800)]
        got = packing.best_fit(sizes, 50, most)
        used = {}
        for (b, place), s in zip(got, sizes, strict=True):
            assert place == used.get(b, 0)
            used[b] = place + s
        assert max(used.values()) <= 50
        places, opened = slow_best_fit(sizes, 50, most)
        assert len(used) == opened and sorted(p for _, p in got) == sorted(places)


def test_packing(spark):
    rng = random.Random(4)
    lengths = {k: rng.randint(1, 120) for k in range(2000)} | {5000: 1000, 5001: 100, 5002: 200}
    rows = [(k, n) for k, n in lengths.items()] + [(6000, 0), (6001, None)]
    df = spark.createDataFrame(rows, "id long, n_tokens long")
    packed = packing.pack(df, 100, 16, items_per_packer=700)
    pieces: dict = {}
    filled: dict = {}
    for r in packed.collect():
        pieces.setdefault(r["id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
        filled.setdefault(r["container_id"], []).append((r["place"], r["n_tokens"]))
    for i, n in lengths.items():
        got = sorted(pieces[i])
        assert sum(p[2] for p in got) == n and (len(got) == 1 or n > 100) and [p[1] for p in got] == [100 * k for k in range(len(got))]
    assert 6000 not in pieces and 6001 not in pieces
    for parts in filled.values():
        at = 0
        for place, n in sorted(parts):
            assert place == at
            at += n
        assert at <= 100
    again = packing.pack(df.repartition(9), 100, 16, items_per_packer=700)
    assert packed.exceptAll(again).count() == 0
    assert packing.fill_report(packed, 100).first()["unused_share"] < 0.05
    assert packing.pack(df.limit(0), 100).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "数据" * 5000), (5, "😀<|endoftext|>")], "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in packing.token_counts(df, "id", "text").collect()}
    assert got[1] <= 3 and got[2] == got[3] == 0 and got[4] > 1000 and got[5] > 1
    for text in ("hello world", "数据 平台\n\n 😀<|endoftext|>", "'s x  y\t"):
        assert packing._encoding(packing.TOKENIZER).decode(packing.encode(text)) == text


INSULTS = ("闭上你的臭嘴，{}", "组长是个{}，谁服他谁倒霉", "what kind of {} signs off such plans", "only a {} would ship this forecast")
WORDS = ("废物", "蠢货", "imbecile", "cretin", "饭桶", "bastard")
HARMLESS = ("公告提醒：用“{}”之类称呼他人将被禁言", "the policy forbids words like {} at work", "复盘时发现第{}号方案的缺口最大", "the team will review plan {} and publish notes")


def labelled(rng, n):
    texts, labels = [], []
    for _ in range(n):
        parts = [rng.choice(HARMLESS[2:]).format(rng.randint(1, 99)) for _ in range(rng.randint(2, 8))]
        bad = rng.random() < 0.3
        if bad:
            parts.insert(rng.randrange(len(parts)), rng.choice(INSULTS).format(rng.choice(WORDS)))
        elif rng.random() < 0.5:
            parts.insert(0, rng.choice(HARMLESS[:2]).format(rng.choice(WORDS)))
        texts.append("。".join(parts) + "\n")
        labels.append(float(bad if rng.random() > 0.03 else not bad))
    return texts, labels, None


def test_held_out_accuracy():
    rng = random.Random(5)
    texts, labels, _ = labelled(rng, 700)
    machine = abuse.train(texts, labels)
    bad = [i.format(w) for i in INSULTS for w in WORDS]
    good = [h.format(w) for h in HARMLESS[:2] for w in WORDS] + [h.format(k) for h in HARMLESS[2:] for k in range(100, 110)]
    assert (machine.score(bad) >= 0.5).mean() >= 0.95 and (machine.score(good) < 0.5).mean() >= 0.95
    assert machine.score(["闭上你的臭嘴，废-物", "复盘。" * 5000 + INSULTS[0].format("蠢货")]).min() >= 0.5
    assert machine.score([None, "", "。。", "  "]).tolist() == [0, 0, 0, 0]
    assert np.array_equal(machine.score(bad), abuse.train(texts, labels).score(bad))


def test_scoring_tables(spark):
    texts, labels, _ = labelled(random.Random(6), 300)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(900, None, 1), (901, "", 1), (1, texts[1], 1)], "doc_id long, text string, label int")
    votes = spark.createDataFrame([(k, f"r{j}", int(v)) for k, v in enumerate(labels) for j in range(1 + k % 2)] + [(3, "r9", None), (None, "r", 1)], "doc_id long, rater string, is_abusive int")
    machine = abuse.fit_machine(docs, votes)
    saved = abuse.fit_machine(docs, votes)
    assert np.array_equal(saved.weights, machine.weights) and np.array_equal(saved.factors, machine.factors) and saved.bias == machine.bias
    scored = abuse.score_documents(docs, machine)
    assert scored.columns == [*docs.columns, "abuse_score"] and scored.count() == docs.count()
    assert {r["abuse_score"] for r in scored.where("doc_id >= 900").collect()} == {0.0}
    assert abuse.fit_machine(docs, votes.where("is_abusive = 0")) is None
    assert abuse.fit_machine(docs, votes.limit(0)) is None
    assert abuse.score_documents(docs, None).agg({"abuse_score": "max"}).first()[0] == 0
    assert abuse.score_documents(docs.limit(0), machine).count() == 0
