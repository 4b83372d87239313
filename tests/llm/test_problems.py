"""The numbered problems on small literal cases, against brute force, round trips and held-out ratings."""

import random
import time
import types
import unicodedata

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from lectern.llm import boilerplate, codes, encode, leaks, near_pairs, page, readability, repeated_lines, residue, split

DOC = "doc_id long, doc_ref string, title string, text string, extra string"


def docs(spark, *rows):
    """(doc_id, text) or (doc_id, text, title); with a column that clashes with names used inside."""
    full = [(r[0], f"r{r[0]}", r[2] if len(r) > 2 else None, r[1], "x") for r in rows]
    return spark.createDataFrame(full, DOC).withColumnRenamed("extra", "_text")


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# 1: splitting

LIMITS = [("default", 60, 8), ("web", 60, 8), ("faq", 40, 0)]
CHUNK = "chunk_id string, section_path array<string>, chunk_rule string, text string, token_count int, piece_no string"


def chunk_tables(spark, rows):
    return spark.createDataFrame(rows, CHUNK), spark.createDataFrame(LIMITS, "chunk_rule string, max_chars int, overlap_chars int")


@pytest.mark.parametrize("seed", range(40))
def test_pieces_keep_limit_overlap_and_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["句子。", "word ", "\n", "\r\n", "长" * rng.randint(1, 50), "a.b ", "！", "é", "\n\n", "x" * rng.randint(1, 90)]) for _ in range(rng.randint(0, 60)))
    limit, overlap = rng.randint(5, 90), rng.randint(0, 60)
    got = split.split_text(text, limit, overlap)
    shared = min(overlap, limit - 1)
    stripped = text.strip(split.BLANKS)
    assert all(len(p) <= limit for p in got)
    assert got[0] + "".join(p[shared:] for p in got[1:]) == stripped
    assert all(a[len(a) - shared :] == b[:shared] for a, b in zip(got, got[1:]))


def fewest_forced(text, limit, overlap):
    """The least number of cuts that aren't natural, by dynamic programming over all places."""
    natural = {p for p, s in zip(*split.boundaries(text)) if s >= split.SENTENCE}
    best = {}
    for end in range(overlap + 1, len(text) + 1):
        came = [0] * (end <= limit) + [best[c] for c in best if end - (c - overlap) <= limit]
        if came:
            best[end] = min(came) + (end < len(text) and end not in natural)
    return best[len(text)]


@pytest.mark.parametrize("seed", range(60))
def test_no_cut_is_forced_without_need(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["句子。", "word ", "\n", "长" * rng.randint(1, 30), "！", "x" * rng.randint(1, 50)]) for _ in range(rng.randint(5, 40))).strip(split.BLANKS)
    limit = rng.randint(12, 60)
    overlap = rng.randint(0, limit // 2)
    natural = {p for p, s in zip(*split.boundaries(text)) if s >= split.SENTENCE}
    if len(text) > limit:
        ends = split.cut_places(text, limit, overlap)
        assert sum(e not in natural for e in ends[:-1]) == fewest_forced(text, limit, overlap)


def test_very_long_texts_are_cut_in_linear_time():
    text = "这是一句话，说了一些事情。" * 150_000 + "x" * 50_000 + "And a sentence of some more words. " * 100_000
    began = time.time()
    got = split.cut_pieces(text, 600, 70)
    assert time.time() - began < 60 and all(len(p) <= 600 for p, _ in got) and sum(part > 600 for _, part in got) >= 80


def test_cuts_fall_on_sentences_where_there_are_any():
    text = "这是一句完整的话。" * 40
    got = split.split_text(text, 60, 0)
    assert all(p.endswith("。") for p in got) and max(map(len, got)) - min(map(len, got)) <= 18


def test_split_operator(spark):
    rows = [
        ("a", ["h"], None, " " + "短句。" * 30 + "　", -1, "c"),
        ("a", ["h"], None, " " + "短句。" * 30 + "　", -1, "c"),
        ("b", None, "faq", "x" * 100, None, "c"),
        ("c", [], "web", None, 3, "c"),
        ("d", [], "web", " \t\r\n　", 3, "c"),
        ("e", [], "unheard of", "fits", 0, "c"),
        ("f", [], "web", "y" * 60, 0, "c"),
    ]
    chunks, limits = chunk_tables(spark, rows)
    assert pairs(split.oversized(chunks, limits), "chunk_id", "forced") == [("a", 0), ("b", 1)]
    got = {}
    for r in split.pieces(chunks, limits).orderBy("chunk_id", "piece_no").collect():
        got.setdefault(r["chunk_id"], []).append(r)
    assert [p["text"] for p in got["b"]] == ["x" * 34, "x" * 33, "x" * 33] or [len(p["text"]) for p in got["b"]] == [33, 34, 33]
    assert got["a"][0]["section_path"] == ["h"] and all(p["token_count"] == len(p["text"]) // 2 for p in got["a"])
    assert (got["c"][0]["text"], got["c"][0]["token_count"]) == (None, 0) and (got["d"][0]["text"], got["d"][0]["token_count"]) == ("", 0)
    assert got["e"][0]["token_count"] == 2 and len(got["f"]) == 1
    empty = chunks.limit(0)
    assert split.pieces(empty, limits).count() == split.oversized(empty, limits).count() == 0
    assert split.pieces(chunks, limits.limit(0)).count() == 6  # without limits all stay whole


# 2: main bodies

PAGE = """登录 | 注册 | 帮助
首页 · 人才培养 · 读者服务
当前位置：首页 > 正文
关于甲乙丙丁社团的说明
来源：图书馆 编辑：值班一组 审核：办公室
一、甲乙丙丁社团场地使用
请带好成绩单，并按顺序排队。甲乙丙丁社团在二楼。
推荐阅读
· 关于戊己庚辛讲堂的通知
04-23 2018年壬癸子丑社团报名方式公布
甲乙楼厅：周一至周五 7:00—22:30
本办法由图书馆负责解释。
版权所有 © 2011-2024 某大学图书馆
电话：0000-13444898 传真：0000-97914651"""


def test_furniture_and_matter(spark):
    df = docs(spark, (1, PAGE, "关于甲乙丙丁社团的说明"), (2, None), (3, ""), (4, " \n\t"), (5, PAGE), (6, "Home\r\nAbout\r\nNews\r\nA line of matter that says something."))
    got = {}
    for i, n in pairs(boilerplate.furniture_lines(df), "doc_id", "line_no"):
        got.setdefault(i, []).append(n)
    assert got == {1: [1, 2, 3, 5, 8, 9, 10, 13, 14], 5: [1, 2, 3, 5, 8, 9, 10, 13, 14], 6: [1, 2, 3]}
    bodies = dict(pairs(boilerplate.main_bodies(df.where("doc_id != 2")), "doc_id", "body"))
    assert bodies[1].startswith("关于甲乙丙丁社团的说明\n一、") and bodies[1].endswith("负责解释。")
    assert bodies[3] == bodies[4] == "" and boilerplate.main_bodies(df.where("doc_id = 2")).first()["body"] is None
    assert boilerplate.furniture_lines(df.limit(0)).count() == 0


def test_menus_in_any_dress():
    for line in ("首页　English　信息公开", "[首页] | 新闻动态", "Home / About / [News]", "ＨＯＭＥ ｜ ＡＢＯＵＴ", "· 首页 · 联系我们"):
        assert page.furniture(line + "\n\n这里才是正文，它说了一些事情。") == [1], line
    assert page.furniture("服务预约\n这里讲预约的办法，很长的一段话。\n资源导航\n又一段话，讲资源在哪里。") == []


MARGINS = """Skip navigation
© Example University
Was this page helpful?
Comments (12)
Related topics
加入收藏  设为首页
招生  院系  科研  校园生活
Log out
Admissions | Departments | Campus life
Site feedback
↑ Top
More stories
订阅我们
快速链接
校内导航
Follow @example
返回列表
Next story »
手机版
Cookie choices""".split("\n")
BODIES = [
    "各位同学在借用场地以前，应当先到学生服务大厅登记，并说明用途和人数。\n登记以后三天内会收到回复，请按约定的时间到场，爱护公共设备。",
    "Students who wish to use the hall must register at the service desk before the start of term.\nThe desk replies within three days and keeps a list of all bookings that were made.",
]


@pytest.mark.parametrize("matter", [BODIES[0], BODIES[1], "场地借用说明\n" + BODIES[0], "Using the hall\n" + BODIES[1]])
def test_margins_are_known_by_their_place(matter):
    n = matter.count("\n") + 1
    missed = sum((page.furniture(f"{line}\n{matter}") != [1]) + (page.furniture(f"{matter}\n{line}") != [n + 1]) for line in MARGINS)
    assert missed <= 2
    both = page.furniture("\n".join([*MARGINS, matter, *MARGINS]))
    assert len(both) >= 2 * len(MARGINS) - 2 and not set(both) & set(range(len(MARGINS) + 1, len(MARGINS) + n + 1))


@pytest.mark.parametrize(
    "text",
    [
        "场地借用说明\n" + BODIES[0] + "\n联系方式\n联系人：王老师 电话：0000-1234567\n开放时间：周一至周五 8:00—17:00",
        "Using the hall\n" + BODIES[1] + "\n(1) bring a card\n(2) pay at the desk",
        "Using the hall\n" + BODIES[1] + "\nday | hall | fee\nMonday | small | 4\n",
        "关于场地借用的说明\n" + BODIES[0] + "\n书院与住宿保留根据实际情况调整安排的权利",
        "请启用 JavaScript",
        "敬请期待",
    ],
)
def test_matter_at_the_edges_stays(text):
    assert page.furniture(text) == []


def test_rendering_of_markup(spark):
    df = spark.createDataFrame([(1, "<body><nav>x</nav>" + "<div>" * 5000 + "deep<p hidden>no"), (2, None), (3, "")], "doc_id long, markup string")
    assert sorted((r["doc_id"], r["text"]) for r in boilerplate.rendered(df).collect()) == [(1, "deep"), (2, None), (3, "")]


def test_tables_and_gaps():
    text = "标题甲\n\n\n\n第一段话，说了一些事情。\na | b | c\nlong | x | y\n\n末段话，也说了一些。"
    assert page.matter(text) == "标题甲\n\n第一段话，说了一些事情。\na    | b | c\nlong | x | y\n\n末段话，也说了一些。"
    markup = "<html><nav>首页</nav><body><p>one<p>two<script>x</script><table><tr><td>a<td>b</table></body></html>"
    assert page.matter(markup) == "one\ntwo\na | b"


def test_very_long_lines_and_texts():
    text = "\n".join(["字" * 200_000, "首页", "联系我们", "新闻动态", "正文一段话，到此为止。"] * 3)
    assert len(page.furniture(text)) == 9


# 3: repeated lines


def brute_lines(rows, site):
    table = {}
    size = {}
    for i, text in rows:
        if text is None or i not in site:
            continue
        size[site[i]] = size.get(site[i], 0) + 1
        for n, line in enumerate(text.split("\n"), 1):
            key = "".join(c for c in unicodedata.normalize("NFKC", line).lower() if unicodedata.category(c)[0] == "L")
            if key:
                table.setdefault((site[i], key), []).append((i, n))
    return sorted(x for (s, _), where in table.items() if len({i for i, _ in where}) >= max(5, 0.02 * size[s]) for x in where)


@pytest.mark.parametrize("capacity", [2, 4096])
def test_repeated_lines_are_exact(spark, capacity):
    rng = random.Random(3)
    words = ["Share THIS", "share this!", "ｓｈａｒｅ ｔｈｉｓ", "版权所有", "版权-所有 1", "12345", "", "rare"]
    rows = [(i, "\n".join(rng.choice(words + [f"own {chr(97 + i % 26)}{chr(97 + i // 26)}"]) for _ in range(rng.randint(0, 8)))) for i in range(120)] + [(200, None), (201, "Share this")]
    site = {i: ("big" if i % 3 else "small") for i, _ in rows if i != 201}
    manifest = spark.createDataFrame([(f"r{i}", s) for i, s in site.items() for _ in range(2)] + [(None, "x"), ("r5", None)], "doc_id string, source_id string")
    df = docs(spark, *rows).repartition(4)
    sited = repeated_lines.sited_lines(df, manifest)
    found = repeated_lines.repeated_lines(sited, repeated_lines.repeated(sited, capacity=capacity))
    assert pairs(found, "doc_id", "line_no") == brute_lines(rows, site)


def test_lines_without_broadcast_and_without_input(spark, monkeypatch):
    rows = [(i, f"same\nown {i}") for i in range(8)]
    manifest = spark.createDataFrame([(f"r{i}", "s") for i in range(8)], "doc_id string, source_id string")
    monkeypatch.setattr(repeated_lines, "BROADCAST_ROWS", -1)
    # "own 1" and "own 2" are the same letters
    lines = repeated_lines.found_lines(docs(spark, *rows), manifest)
    assert pairs(lines, "doc_id", "line_no") == sorted([(i, 1) for i in range(8)] + [(i, 2) for i in range(8)])
    left = repeated_lines.without_lines(docs(spark, (1, "a\nb\nc"), (2, None), (3, "z")), spark.createDataFrame([(1, 2), (1, 3), (9, 1)], "doc_id long, line_no int"))
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: "a", 2: None, 3: "z"}
    assert repeated_lines.found_lines(docs(spark, *rows).limit(0), manifest).count() == repeated_lines.found_lines(docs(spark, *rows), manifest.limit(0)).count() == 0


# 4: residue


@pytest.mark.parametrize(
    "text, kind",
    [
        ("关于{{title}}的通知\n尊敬的${name}：\n%ORG%定于{{date}}在__PLACE__举行。\n联系人«姓名»", "placeholder"),
        ("Dear [insert name here],\nThe <EVENT> takes place on [Date TBC].\nSigned, __NAME__", "placeholder"),
        ("示例\n占位文本。占位文本。占位文本。", "filler"),
        ("Lorem ipsum dolor sit amet.\nAmet lorem dolor ipsum sit.", "filler"),
        ("404 页面不存在\n您请求的资源/x找不到了。\n将在 5 秒后返回。", "notice"),
        ("HTTP 502 Bad Gateway\nPlease try again later.", "notice"),
        ("请启用 JavaScript 后重新加载", "notice"),
        ("java.lang.IllegalStateException: bean a.b missing\nat org.a.Page.render(Page.java:12)", "notice"),
        ("首页\n新闻动态\n联系我们\n页面建设中\n敬请期待……\n版权所有 © 2011-2024 某大学", "notice"),
        ("邮件模板中的“{{name}}”与“${date}”会在发送通知时自动替换。请各位同学留意，下面说明如何办理，需要带好学生证。", None),
        ("Fields such as {{name}} or %DATE% are replaced when the letter is sent. Each student should check the result.", None),
        ("打开主页时如果看到“404 页面不存在”，通常是链接过期。宿舍长请在工作日上午到网络服务点借用设备，并带好学生证原件。", None),
        ("公式记作 \\frac{a_{i}}{b}，其中参数由导师组给出，请各位同学在第十周以前交回作业本，逾期不予受理。", None),
        ("本站需启用 JavaScript 以获得最佳浏览效果\n这里是正文，它说了很多事情，也说得清楚，读者可以照着办理。", None),
        ("负责人【待定】。\n" + "这里是正文，它说了很多事情，也说得清楚，读者可以照着办理。\n" * 4, None),
        ("", None),
        (" \n\t", None),
        (None, None),
    ],
)
def test_residue(text, kind):
    share, found = residue.residue_share(text, None)
    assert (found if share >= residue.SHARE else None) == kind


FENCED = """Writing letters with the mail tool

Each letter starts from a template that the office keeps. Fields in double braces are filled in from the list of recipients.

```
Dear {{ first_name }},
{{ course }} starts on {{ date }}.
Room: {{ room }}
{{ signature }}
```

Save the file and send yourself a copy before the letters go out."""
LOGGED = """When the portal does not open

If the portal stays blank, look into the log of the proxy first. A full disk shows up like this:

~~~
HTTP 502 Bad Gateway
java.io.IOException: no space left
at org.proxy.Writer.write(Writer.java:88)
Please try again later.
~~~

Delete the old logs and start the proxy again, then tell the help desk what you found."""


@pytest.mark.parametrize(
    "text",
    [
        FENCED,
        LOGGED,
        LOGGED.replace("~~~\n", "<pre>\n", 1).replace("~~~", "</pre>"),
        FENCED.replace("```\n", "", 1).replace("\n```", "").replace("recipients.\n", "recipients:\n").replace("\nDear", "\n    Dear").replace("\n{{", "\n    {{").replace("\nRoom", "\n    Room"),
        "模板的写法\n通知模板由办公室维护，发送时系统会按收件人名单逐一替换其中的变量。\n示例如下：\n尊敬的{{name}}：\n{{course}}将于{{date}}开课。\n发送前请先给自己寄一份，确认无误后再群发。",
        "The variable {{ first_name }} holds the name of the recipient as it stands in the list of the office.\nThe template tag {{ date }} becomes the day on which the course of the recipient starts.",
    ],
)
def test_code_and_tutorials_are_no_residue(text):
    assert residue.residue_share(text)[0] < residue.SHARE


@pytest.mark.parametrize(
    "text",
    [
        "```\n{{ title }}\n{{ body }}\n```",
        "Notice\nDear {{ first_name }},\n{{ course }} starts on {{ date }}.\nRoom: {{ room }}\n{{ signature }}",
        "<pre>\nHTTP 502 Bad Gateway\nPlease try again later.\n</pre>",
    ],
)
def test_residue_in_code_without_prose_stays_residue(text):
    assert residue.residue_share(text)[0] >= residue.SHARE


def test_residue_operator(spark):
    df = docs(spark, (1, "404 页面不存在"), (2, None), (3, "正文说了很多事情，也说得清楚。"), (4, "页面建设中", None), (4, "页面建设中", None))
    assert pairs(residue.residues(df), "doc_id", "residue") == [(1, "notice"), (4, "notice"), (4, "notice")]
    assert residue.residues(df.limit(0)).count() == 0 and residue.residues(df.select("doc_id", "text")).count() == 3


# 5: overlaps between splits

CASE = "question_id string, question string, split_name string, source_id string, wording string"


def cases(spark, *rows):
    return spark.createDataFrame([(i, q, s, "src", "clash") for i, q, s in rows], CASE)


def found_pairs(df):
    return sorted((r["train_id"], r["held_id"]) for r in near_pairs.overlaps(df).expanded().collect())


def noise(n):
    rng = random.Random(5)
    pool = "琛岱鸾鹄昀弋翮焓檀樨嵘骊珏璞翊曦淙沅瑗楹"
    kinds = ["社团", "讲堂", "公寓", "研究所"]
    return [(f"n{i}", f"{''.join(rng.choice(pool) for _ in range(4))}{rng.choice(kinds)}在20{10 + i % 9}年的退改办法是怎样规定的？", "train") for i in range(n)]


def test_overlaps_allow_slips_and_greetings_only(spark):
    rows = [
        ("t1", "蓼莳绯桢社团在2018年的所需材料是怎样规定的？", "train"),
        ("t1", "蓼莳绯桢社团在2018年的所需材料是怎样规定的？", "train"),
        ("d1", "请问，蓼莳绯桢社团在２０１８年 的 所需材料是如何规定的？谢谢", "dev"),
        ("d2", "蓼莳绯桢桢社团在2018年的所材需料是怎样规定的？", "test"),
        ("d3", "蓼莳绯桢社团在2019年的所需材料是怎样规定的？", "test"),
        ("d4", "蓼莳绯桢社团在2018年的费用说明是怎样规定的？", "demo"),
        ("d5", "蓼莳绯桢讲堂在2018年的所需材料是怎样规定的？", "demo"),
        ("d6", "霭涟泓绮社团在2018年的所需材料是怎样规定的？", "demo"),
        ("e1", "What are the fees rules of the Kabonuzibu Exchange in 2023?", "train"),
        ("d7", "HELLO, WHICH ARE THE FEES RULES OF THE KABONUIZBU EXCHANGE IN 2023? Thanks", "dev"),
        ("d8", "What are the fees rules of the Kabonuzibu Archive in 2023?", "dev"),
        ("d9", None, "dev"), ("da", "  ？ ", "dev"), ("db", "蓼莳绯桢社团在2018年的所需材料是怎样规定的？", None), (None, "x", "train"),
    ]
    assert found_pairs(cases(spark, *rows, *noise(150))) == [("e1", "d7"), ("t1", "d1"), ("t1", "d2")]


@pytest.mark.parametrize("long, most", [(near_pairs.LONG, 10_000), (2, -1)])
def test_cosine_join_is_exact(spark, monkeypatch, long, most):
    monkeypatch.setattr(near_pairs, "BROADCAST_ROWS", most)
    monkeypatch.setattr(near_pairs, "BROADCAST_VECTORS", most)
    rng = random.Random(7)
    words = [f"w{chr(97 + i)}{chr(97 + i % 7)}x" for i in range(26)]
    texts = sorted({" ".join([*sorted(rng.sample(words, rng.randint(2, 6))), str(rng.randint(1, 2))]) for _ in range(160)})
    classes = spark.createDataFrame([(i, t, i % 2 == 0, i % 3 != 0) for i, t in enumerate(texts)], "cid long, wording string, train boolean, held boolean").where("train or held")
    listed = {i: set(near_pairs.terms(t)) for i, t in enumerate(texts)}
    listed = {i: t for i, t in listed.items() if i % 2 == 0 or i % 3}
    df = {}
    for t in listed.values():
        for x in t:
            df[x] = df.get(x, 0) + 1
    idf = {x: max(near_pairs.LEAST_WEIGHT, np.log(len(listed) / n)) for x, n in df.items()}
    norm = {i: np.sqrt(sum(idf[x] ** 2 for x in t)) for i, t in listed.items()}
    cos = lambda a, b: sum(idf[x] ** 2 for x in listed[a] & listed[b]) / norm[a] / norm[b]
    for threshold in (0.3, 0.6):
        want = {(a, b): cos(a, b) for a in listed if a % 2 == 0 for b in listed if b % 3 if cos(a, b) >= threshold}
        got = {(r["a"], r["b"]): r["cosine"] for r in near_pairs.cosine_pairs(classes, threshold, long).collect()}
        assert len(want) > 20 and want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def slipped(rng, text):
    """Up to two slips of the pen, and politeness."""
    for _ in range(rng.randint(0, 2)):
        i = rng.randrange(len(text) - 2)
        text = rng.choice([text[:i] + text[i + 1] + text[i] + text[i + 2 :], text[:i] + text[i] + text[i:], text[:i] + text[i + 1 :]])
    return rng.choice(["", "请问", "Hello, "]) + text + rng.choice(["", "？", " ?", "谢谢"])


def test_recall_against_brute_force(spark):
    """Wordings that the threshold wasn't chosen on."""
    rng = random.Random(11)
    han, letters = [chr(c) for c in range(0x5100, 0x5180)], "bcdfglmnprstaeiou"
    rows, made = [], []
    for i in range(500):
        name, other = "".join(rng.choice(han) for _ in range(rng.randint(4, 6))), "".join(rng.choice(letters) for _ in range(9))
        aspect, kind = rng.choice(["退费标准", "报名时间", "申请材料", "住宿安排", "奖励办法"]), rng.choice(["中心", "体育馆", "合唱团"])
        frames = [f"{name}{kind}{rng.randint(2015, 2025)}年{aspect}有何变动", f"When does the {other} office open in {rng.randint(2019, 2022)}, and who may register there", f"新生加入{name}{kind}之前需要知道的{aspect}"]
        made.append(rng.choice(frames))
        rows.append((f"t{i}", made[-1], "train"))
    rows += [(f"d{i}", slipped(rng, rng.choice(made)), rng.choice(["dev", "test"])) for i in range(400)]
    folds = {i: near_pairs.folded(t) for i, t, _ in rows}
    want = {(a, b) for a, _, s in rows if s == "train" for b, _, u in rows if u != "train" if near_pairs.same_question(folds[a], folds[b])}
    got = set(found_pairs(cases(spark, *rows)))
    assert len(want) > 250 and got <= want and len(got) >= 0.99 * len(want)


def test_overlaps_of_copies_and_of_nothing(spark):
    same = [(f"t{i}", "same question again", "train") for i in range(3)] + [(f"d{i}", "Same question, again?", "dev") for i in range(2)]
    df = cases(spark, *same, ("t0", "another wording altogether", "train"), ("d7", "another wording, altogether", "test"), ("d8", "something else", "dev"))
    found = near_pairs.overlaps(df)
    pairs = [(r["train_id"], r["held_id"]) for r in found.expanded(long=1).collect()]
    assert sorted(pairs) == sorted([(f"t{i}", f"d{j}") for i in range(3) for j in range(2)] + [("t0", "d7")])
    assert sorted((r["split_name"], r["source_id"], r["n_pairs"], r["n_held"]) for r in found.counts().collect()) == [("dev", "src", 6, 2), ("test", "src", 1, 1)]
    links = sorted((r["question_id"], r["n_links"]) for r in found.classes().collect())
    assert links == [("d0", 3), ("d1", 3), ("d7", 1), ("d8", 0), ("t0", 1), ("t0", 2), ("t1", 2), ("t2", 2)]
    assert found_pairs(df.limit(0)) == [] and found_pairs(df.where("split_name = 'train'")) == []


# 2, 4, 8: pages are folded and keyed as a whole


def folded_whole(text):
    return page._STRAY.sub(" ", page._INVISIBLE.sub("", unicodedata.normalize("NFKC", text)))


def test_folding_one_by_one_is_folding_whole():
    rng = random.Random(6)
    signs = "aÀé中，：（）！　\xa0…©»▪™½①㎡ﬁ\u200b\xad\ufeffＡｂ９ｶﾞ가\u1100\u1161\u11a8한e\u0301\u0323\u09c7\u09be<|x>[pad]Σσ\u0130😀\ufffd\n"
    for _ in range(5000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        assert page.folded(text) == folded_whole(text)
        lines = page.folded(text).split("\n")
        assert page.keys_of(lines) == [page.key_of(line) for line in lines]


def test_usual_pages_are_not_normalized_whole(monkeypatch):
    normalized = []
    counted = types.SimpleNamespace(category=unicodedata.category, normalize=lambda form, text: normalized.append(text) or unicodedata.normalize(form, text))
    monkeypatch.setattr(page, "unicodedata", counted)
    text = "学校教务部：“答复”，（2024年）…… © ▪ »　办事指南！\n" * 200
    assert page.folded(text) == folded_whole(text) and page.parse(text, "办事指南：")
    assert sum(map(len, normalized)) < 50  # characters, each once


def test_forms_of_short_lines_are_found_once(monkeypatch):
    searched = []

    class Counted:
        def search(self, line):
            searched.append(line)
            return notices.search(line)

    notices = residue._NOTICES
    monkeypatch.setattr(residue, "_NOTICES", Counted())
    for i in range(50):
        residue.residue_share(f"学院第{i}号通知的全文如下。\n本学院的教学安排由教务部负责。\n请各位同学按时参加考试。", None)
    assert searched.count("请各位同学按时参加考试。") == 1


# 6: encoding


@pytest.fixture(scope="module")
def vocabulary():
    return encode.Vocabulary(encode.read_ranks(encode.VOCABULARY))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("given", pat_str=encode.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_the_library_is_only_the_measure():
    assert not {"tiktoken", "tokenizers", "sentencepiece"} & {getattr(m, "__name__", "") for m in vars(encode).values()}


def test_pairs_of_tokens(vocabulary):
    def merged(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((vocabulary.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    rng, tokens = random.Random(4), sorted(vocabulary.ranks, key=vocabulary.ranks.get)
    for _ in range(5000):
        a, b = (tokens[rng.randrange(rng.choice([300, 3000, len(tokens)]))] for _ in range(2))
        b = rng.choice([b, b, a])
        assert vocabulary.fits(a, b) == (merged(a + b) == [a, b])


@pytest.mark.parametrize("length", [0, 1, 2, 3, 255, 256, 257, 2047, 2048, 2049, 2051, 5000])
def test_every_length_is_fed_in_steps(vocabulary, library, length, monkeypatch):
    fed = []
    feed = encode.Transducer.feed
    monkeypatch.setattr(encode.Transducer, "feed", lambda self, text: fed.append(len(text)) or feed(self, text))
    for text in ("学校 and the old  schools\n"[i:] * 1000 for i in range(12)):
        fed.clear()
        assert encode.encode_text(text[:length], vocabulary) == library.encode_ordinary(text[:length])
        assert all(n <= encode.FEED for n in fed) and sum(fed) >= length


def test_stream_equals_whole(vocabulary, library):
    rng = random.Random(1)
    parts = ["hello", "World", "教学工作部", "don't", "  ", "\n", "\n\n\n", "12345", "=====", "!!", " ", "\t", "Ǻn̈", "😀😀", "aaaaaaa", "'s", "'ll", "'", "é", "　", "\xa0", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        feed = rng.choice([8, 16, 33, 64, 100])
        ids = encode.encode_text(text, vocabulary, feed)
        assert ids == library.encode_ordinary(text)
        state = encode.TextDecoder(vocabulary)
        assert "".join(state.feed([i]) for i in ids) + state.finish() == text


@pytest.mark.parametrize("text", ["a" * 4000, "abc" * 1500, "尽管阐释学循环" * 400, " " * 3000 + "x", "=" * 3000 + "'s", "1234567890" * 300, " " * 2500, "\n" * 999 + "  b", "étain" * 900])
def test_runs_without_breaks(vocabulary, library, text):
    assert encode.encode_text(text, vocabulary, 128) == encode.encode_text(text, vocabulary) == library.encode_ordinary(text)


def test_pieces_are_closed_together(vocabulary, library, monkeypatch):
    alone = []
    piece = encode.Vocabulary.piece
    monkeypatch.setattr(encode.Vocabulary, "piece", lambda self, text: alone.append(text) or piece(self, text))
    text = "".join(f"第{i}条 学校教务部、the school's office（2024）答复：{chr(0x4E00 + i)}{chr(0x5E00 + 3 * i)}。\n" for i in range(600))
    assert encode.encode_text(text, vocabulary) == library.encode_ordinary(text)
    assert sum(map(len, alone)) < 200  # only what is left at the end


def test_pieces_begin_where_the_pattern_says(vocabulary):
    rng = random.Random(5)
    signs = " '  \n\t\r\x1c\x85\xa0\u2028\u3000abstrevmldSTL019!?.,_-é½Ⅷ中文学\u0301\u0663😀\U00020000"
    for _ in range(5000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 14)))
        begins = vocabulary.starts(text, encode._codes(text))
        assert begins.nonzero()[0].tolist() == [m.start() for m in vocabulary.pieces.finditer(text)]


def test_another_pattern_has_its_own_pieces(vocabulary):
    ids = encode.encode_text("don't 学校 and  schools", encode.Vocabulary(vocabulary.ranks, r"\S+|\s+"))
    assert ids == tiktoken.Encoding("other", pat_str=r"\S+|\s+", mergeable_ranks=vocabulary.ranks, special_tokens={}).encode_ordinary("don't 学校 and  schools")


def test_a_run_is_encoded_in_bounded_memory(vocabulary):
    run = encode._Run(vocabulary)
    for _ in range(40):
        run.add("尽管阐释学循环".encode() * 50)
        assert len(run.data) < 2048


def test_encoding_operator(spark, vocabulary):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json"))
    whole.encode_special_tokens = True
    texts = [None, "", "hello <|endoftext|> 世界", " \r\n\t", "x" * 100_000, "﻿​�"]
    df = docs(spark, *enumerate(texts))
    got = {r["doc_id"]: r["ids"] for r in encode.encoded(df).collect()}
    assert got == {i: whole.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in encode.decoded(encode.encoded(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode.encoded(df.limit(0)).count() == 0


# 7: leaks


def passage(seed, n=30):
    rng = random.Random(seed)
    return "".join("".join(chr(rng.randint(0x5000, 0x8000)) for _ in range(9)) + "。" for _ in range(n))


def test_leaks(spark):
    a, b, stock = passage(1), passage(2), "以上信息以学校当年公布的正式文件为准，请以最新版本作为办理依据。"
    english = " ".join(f"Word{i} follows the other number {i * 37 % 101} here." for i in range(30))
    altered = "".join("错" if i % 40 == 20 else c for i, c in enumerate(a))
    items = spark.createDataFrame(
        [(1, a + stock, "x"), (2, b + stock, "x"), (3, english, "x"), (4, None, "x"), (5, "", "x"), (6, "短", "x"), (1, a + stock, "x")], "item_id long, text string, covered string"
    )
    df = docs(
        spark,
        (10, "前言。" + a + stock + "后记。"),
        (11, altered),
        (12, a[:160] + "中间隔开的话。" * 5 + a[200:]),
        (13, a[:60] + stock),
        (14, stock),
        (15, english.upper().replace(" ", "\r\n")),
        (16, None),
        (17, ""),
        (18, b[120:]),
        (19, "字" * 300_000 + b),
        (20, unicodedata.normalize("NFD", english) + " " + a),
        (20, unicodedata.normalize("NFD", english) + " " + a),
    )
    found = leaks.leaks(df, items)
    assert pairs(found, "doc_id", "item_id") == [(10, 1), (11, 1), (12, 1), (15, 3), (18, 2), (19, 2), (20, 1), (20, 3)]
    assert sorted(r["doc_id"] for r in leaks.without_leaks(df, found).collect()) == [13, 14, 16, 17]
    assert leaks.leaks(df.limit(0), items).count() == leaks.leaks(df, items.limit(0)).count() == 0


def test_leaks_in_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 200)
    items = spark.createDataFrame([(i, passage(i)) for i in range(6)], "item_id int, text string")
    df = docs(spark, *((i, "序" + passage(i)) for i in range(6)))
    assert pairs(leaks.leaks(df, items), "doc_id", "item_id") == [(i, i) for i in range(6)]


def shard_of(texts):
    flat = codes.alnum_table()[codes.points("".join(texts))]
    assert (flat > 0).all()
    return flat, np.cumsum([len(t) for t in texts])


@pytest.mark.parametrize("seed", range(12))
def test_matches_agree_with_brute_force(seed):
    """All verbatim matches of at least 8 ideographs, and no candidate lost that reaches the share."""
    rng = random.Random(seed)
    alphabet = [chr(0x5000 + i) for i in range(40)]
    some = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    stock = some(20)
    items = [some(rng.randint(20, 60)) + (stock if rng.random() < 0.6 else "") + some(rng.randint(0, 30)) for _ in range(40)] + [stock, stock + some(9)]
    texts = []
    for _ in range(40):
        text = some(20)
        for _ in range(rng.randint(0, 3)):
            item = rng.choice([*items, stock])
            at = rng.randint(0, max(0, len(item) - 8))
            text += item[at : at + rng.randint(5, 50)] + some(rng.randint(0, 20))
        texts.append(text)
    index = leaks._Items(items)
    flat, ends = shard_of(texts)
    found = [kind.matches(flat, index.codes, ends) for kind in index.kinds]
    starts = [np.searchsorted(f[0], np.arange(len(texts) + 1)) for f in found]
    begin = np.concatenate(([0], ends))
    candidates = set(leaks._candidates(found, index).tolist())
    for d, text in enumerate(texts):
        for t, item in enumerate(items):
            want = set()
            for i in range(len(text)):
                for j in range(len(item)):
                    if i and j and text[i - 1] == item[j - 1]:
                        continue
                    n = 0
                    while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n]:
                        n += 1
                    if n >= 8:
                        want.add((i, j, n))
            if want:
                pair = d * len(items) + t
                got = [(p - int(begin[d]), q, n) for p, q, n in leaks._runs(pair, found, index, starts)]
                assert set(got) == want
                enough = leaks._covered(index.codes[index.starts[t] : index.starts[t] + len(item)], flat[begin[d] : ends[d]], got, 8)[0] >= leaks.SHARE * len(item)
                assert pair in candidates or not enough


def test_a_stock_sentence_costs_no_product():
    import tracemalloc

    stock = passage(0, 9)
    items = [passage(i + 1, 12) + stock for i in range(300)]
    index = leaks._Items(items)
    texts = [stock + passage(1000 + i, 2) for i in range(9000)] + [items[7] + stock * 400]
    tracemalloc.start()
    began = time.time()
    got = sorted(x[:2] for x in leaks._of_shard(texts, index, leaks.SHARE))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(9000, 7)] and peak < 1 << 30 and time.time() - began < 60


def test_altered_letters_are_found():
    """Passages with letters changed, lost and put in at random: all are found at one letter in forty, nine in ten at one in fifteen."""
    rng = random.Random(3)
    for rate, least in ((40, 1.0), (25, 0.97), (15, 0.9)):
        items = [passage(i, 30) for i in range(60)]
        texts = []
        for item in items:
            out = []
            for c in item:
                x = rng.random() * rate
                out.append(c if x >= 1 else rng.choice(["错", "", c + "误"]))
            texts.append("前言" + "".join(out))
        got = {x[:2] for x in leaks._of_shard(texts, leaks._Items(items), leaks.SHARE)}
        assert got <= {(i, i) for i in range(60)} and len(got) >= least * 60


# 8: reading level

EASY = ["想打球就去宿舍。请把本子放在游泳馆。", "记得带上课本。花园很好玩。", "朋友和大家一起吃饭。今天要学做菜。", "票在车站。明天不要忘了雨伞。"]
HARD = ["尽管阐释学循环的本体论前提通常被还原为弱收敛拓扑之间的退化情形，", "就贝叶斯层级模型的后验收缩而言，倘若将生成性隐喻视为异质性框架，", "其适用范围亦须借助极限定理加以限定，方可成立。", "量子纠缠熵的面积律呈现为有待重新诠释的渐近等价形式。"]
PLAIN = ["We go to the lake. Kids like to play ball.", "Bring a cup and a pen. The gym is near."]
DENSE = ["Notwithstanding the ostensible equivalence, hermeneutic circularity vitiates institutional legitimation.", "Insofar as ergodicity presupposes nonstationarity, phenomenological bracketing relinquishes identification."]


def test_syllables():
    want = {"cat": 1, "table": 2, "make": 1, "reading": 2, "idea": 3, "jumped": 1, "wanted": 2, "boxes": 2, "university": 5, "i": 1}
    assert sum(abs(readability.syllables(w) - n) for w, n in want.items()) <= 1


def test_levels_on_held_out_pages(spark):
    rng = random.Random(2)
    rows, rated = [], []
    for i in range(240):
        hard, wide = i % 2 == 0, i % 4 < 2
        source = (HARD if hard else EASY) if wide else (DENSE if hard else PLAIN)
        rows.append((i, "标题\n" + "\n".join(rng.choice(source) for _ in range(6)) if wide else "A title\n" + "\n".join(rng.choice(source) for _ in range(6))))
        if i < 160:
            rated += [(i, "a", 5 if hard else 1)] * 2
    # an easy page whose sentences are strung together stays easy
    rows += [(1000, "标题\n" + "".join(EASY).replace("。", "，") * 3 + "。"), (1001, None), (1002, " "), (1003, "404 页面不存在"), (1004, "！！！")]
    ratings = spark.createDataFrame(rated + [(None, "a", 3), (9999, "a", 3), (5, "b", None), (5, "c", 77)], "doc_id long, rater string, reading_level int")
    model = readability.fit(docs(spark, *rows), ratings)
    got = {r["doc_id"]: r["level"] for r in readability.levels(docs(spark, *rows), model).collect()}
    right = sum((got[i] >= 4) == (i % 2 == 0) for i in range(160, 240))
    assert right >= 76 and got[1000] <= 3
    assert [got[i] for i in (1001, 1002, 1003)] == [None] * 3


def test_levels_without_ratings(spark):
    df = docs(spark, (1, "一些正文，说了一些事情。"))
    empty = spark.createDataFrame([], "doc_id long, rater string, reading_level int")
    model = readability.fit(df, empty)
    assert [r["level"] for r in readability.levels(df, model).collect()] == [None]
    assert readability.levels(df.limit(0), model).count() == 0 and readability.fit(df.limit(0), empty).fits == {}
