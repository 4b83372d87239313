"""The layout of one page of text: a block tree with implied blocks, and the rules that say which blocks are matter.

A page arrives as lines that some fetcher rendered, or as markup (then ``functions.html`` renders it first, leaving out
invisible and navigation elements).  ``parse`` builds a flat tree: every line opens a block of some kind, and blocks
that are never marked in text are implied.  The page's matter is an implied main block: it begins at the title and ends
with the last line that says something (a sentence, a contact, opening hours, a list of such).  What lies outside it and
looks like links (short, no sentence) is a margin, whatever its words: everything above the title, and below the matter
what follows its last line.  Rows of short items set apart by bars, dots or gaps are implied menus at the margins, and a
title is told from a margin by taking up what the matter speaks of.  Listed words are hints for what stands inside the matter
or beside its title, where position says nothing: a heading such as "related pages" opens an implied list that stays open
until a line that can't be an entry; a run of menu words is an implied menu.  ``matter`` then emits the visible blocks in reading order, keeping paragraph gaps, list bullets and tables, whose
cells are padded to common widths.

Lines are matched on a key that holds letters and digits only, after compatibility folding, so that case, width,
spacing, bullets and brackets make no difference.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from lectern.functions import html

MENU, TRAIL, NOTICE, BYLINE, TOOLS, ASIDE, ENTRY, LEGAL, FOOTER, MARGIN = (
    "menu", "trail", "notice", "byline", "tools", "aside", "entry", "legal", "footer", "margin",
)
FURNITURE = frozenset((MENU, TRAIL, NOTICE, BYLINE, TOOLS, ASIDE, ENTRY, LEGAL, FOOTER, MARGIN))
TITLE, HEADING, TEXT, ITEM, ROW, BLANK = "title", "heading", "text", "item", "row", "blank"

#: What menus of university sites offer.
MENU_WORDS = """首页 网站首页 新闻动态 新闻中心 招生信息 招生就业 资源导航 人才培养 通知公告 信息公开 师资队伍 规章制度
部门概况 学院概况 部门介绍 学术活动 学术研究 科学研究 读者服务 服务预约 机构设置 党建工作 党群工作 联系我们 关于我们 办事指南 服务指南 下载专区
下载中心 常用链接 友情链接 学生工作 校友 english 中文 home about aboutus news events study research people contact contactus visit
services calendar jobs giving alumni media atozindex stafflogin resources sitemap search library""".split()
#: Headings of lists of other pages.
ASIDE_WORDS = """推荐阅读 猜你关注 猜你喜欢 最新通知 最新公告 最新文章 相关链接 相关阅读 相关文章 热门文章 热门推荐 同类信息 延伸阅读
大家都在看 最近更新 更多资讯 更多新闻 其他文章 热点推荐 点击排行 阅读排行 推荐文章 猜您喜欢 精彩推荐
youmayalsolike youmightalsolike relatedpages relatedlinks relatedarticles recommended recommendedforyou latestnotices latestnews mostread
moreinthissection popularpages popularposts trending recentnews recentposts seealso morenews morelikethis alsointhissection otherpages quicklinks""".split()

_MENU = re.compile("(?:%s)+" % "|".join(sorted(MENU_WORDS, key=len, reverse=True)))
_MENU_WORD = frozenset(MENU_WORDS)
_ASIDE = frozenset(ASIDE_WORDS)

#: kind -> patterns that the key must match from its start
_KEYED = {
    TRAIL: r"当前位置|当前所在|所在位置|您(?:现在|当前)?(?:的|所在)?的?位置|您在这里|youarehere|youarein(?:home|section)|breadcrumb|skipto(?:main)?content$",
    NOTICE: r"(?:统一认证)?登录(?:教职工|学生|访客|注册|帮助)+$|login(?:register|help)+$|signin(?:register|help)+$"
    r"|staffstudents(?:visitors|search|alumni)+$"
    r"|(?:本站|本网站|网站).{0,8}(?:启用|开启|支持)javascript.{0,8}(?:效果|体验|浏览)|thissiteworksbestwith|bestviewed(?:in|with)"
    r"|(?:本站|本网站|我们|网站)(?:会)?使用cookie|.{2,16}网站会(?:保存|使用|存储).{0,6}cookie|为统计访问情况|cookie(?:设置|声明|提示)"
    r"|(?:我们|网站|本站)(?:会)?(?:收集|记录)匿名|建议使用.{2,20}浏览器|cookie(?:policy|notice|preferences)$|(?:accept|reject|allow)(?:all)?cookies|weandourpartners|thiswebsiteusescookies|oursiteusescookies|essentialcookiesonly|weusecookies|bycontinuingtobrowse|thissiteusescookies|the.{2,60}sitestorescookies|acceptallcookies|cookiesettings$",
    BYLINE: r"来源.{1,24}(?:编辑|作者|审核)|(?:发布|更新)(?:时间|日期)\d|作者.{1,12}(?:来源|编辑|时间)|编辑.{1,12}审核|责任编辑|(?:撰稿|供稿|摄影|发布人|发布单位|发布者).{1,24}(?:编辑|审核|时间|日期|来源)|(?:最后|最近|上次)(?:更新|修改)(?:时间|于|日期)?\d|您是第\d+位|访问人数\d|今日访问"
    r"|postedby.{2,80}in|publishedby.{2,80}on\d|(?:浏览|阅读|访问|点击)(?:次数|量|数)\d+|阅读\d+次|点击\d+次|views?\d+$"
    r"|\d+(?:people|readers|users|visitors)?(?:have)?(?:read|viewed|visited)this(?:page|article)|readby\d+|\d+人(?:已|次)?(?:阅读|浏览|看过)"
    r"|\d+(?:views?|reads?|comments?|clicks|hits)$|readingtime\d|\d+minread$|writtenby.{2,60}(?:on|in)|lastmodified\d|updatedon\d|lastupdated\d+(?:visits)?|\d+visits$|页面?浏览量",
    TOOLS: r"分享(?:到|至)|一键分享|转发(?:到|至|给)(?:微信|朋友圈|好友|同学|朋友)|复制链接$|扫一扫|扫码关注|关注我们$|放大字体|缩小字体|导出pdf$|下载pdf$|意见反馈$|我要纠错$|分享本页|分享给|觉得有用.{0,8}(?:转发|分享)|收藏本页|返回顶部$|回到顶部$|打印本页|关闭窗口$|字体大中小|字号大中小"
    r"|tellafriendabout|foundthisuseful|sharethis(?:page|site|article)(?:on|with|via|by|mail|email|chat|copy|link|facebook|twitter|wechat)|shareon(?:facebook|twitter|x)"
    r"|sharevia|shareto(?:your)?(?:friends|wechat|facebook)|followus(?:on)?|subscribe(?:to|now)?(?:our)?(?:newsletter)?$|fontsize|downloadaspdf$|saveaspdf$|emailthisto|printthispage|printerfriendly|closewindow$|textsizea|backtotop$|emailthispage",
    LEGAL: r"版权所有|本[页站]内容版权|.{0,30}未经许可不得(?:转载|复制)|免责声明|法律声明|隐私(?:政策|声明)|使用本站即视为"
    r"|copyrightofthispage|copyright(?:19|20)\d\d|(?:19|20)\d\d(?:19|20)?\d{0,2}.{2,80}allrightsreserved|disclaimer|useofthissiteimplies"
    r"|网站地图$|站点地图$|无障碍(?:声明|浏览)$|copyright©?\d|poweredby.{2,30}$|termsandconditions$|accessibilitystatement$|privacy(?:accessibility|policy|notice|sitemap)+$|termsofuse(?:privacy|accessibility)*$",
    FOOTER: r"地址.{2,40}邮编\d|邮编\d{4,}|电话\d{5,}(?:传真\d*)?$|传真\d{5,}$|技术支持.{2,30}备案|.{0,4}icp备|备案号|主办单位.{2,30}承办"
    r"|tel\d{5,}(?:fax\d*)?$|fax\d{5,}$",
}
_KEYED_RE = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _KEYED.items()))
_ADDRESS = re.compile(r"\W*\d{1,5} +[a-z' -]{2,40}\b(?:avenue|street|road|boulevard)\b[^.]{0,40}$", re.I)
_FIELD = re.compile(r"[{}%$<>«»_]")
_OPEN = re.compile(r"[{}%$<>«_]")
_NEIGHBOUR = re.compile(r"[上下]一[篇条页则]\s*[::]|(?:previous|next)(?: (?:page|article|post))?\s*:", re.I)
_CRUMBS = re.compile(r"\W*(?:首页|主页|home)\s*(?:[>›»→]|-->)\s*\S", re.I)

_STRAY = re.compile(r"<\|[^|<>]{1,30}\|>|</?s>|\[(?:unk|pad|cls|sep|mask)\]", re.I)
_INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿￹-�]")
_NOT_KEY = re.compile(r"[\W_]+")
_MARKUP = re.compile(r"<(?:!doctype|html|body|div|table|ul|nav|article)\b[^>]*>", re.I)
_BULLET = re.compile(r"[-*·•▪»>\s]+")
_DATED = re.compile(r"^\d{1,2}[-/]\d{1,2}\s+\S|\[\d{4}-\d{1,2}-\d{1,2}\]\s*\W*$|\(\d{4}-\d{1,2}-\d{1,2}\)\s*\W*$")
_ENTRY_ZH = re.compile(r"^关于.{2,40}的(?:通知|公告|通告|公示|函)$|(?:问答|一览|公布|公示|公告|通知|揭晓|启事)$|^[^:。]{2,30}:[^:。]{2,14}$")
_ENTRY_EN = re.compile(r"^(?:notice (?:on|about|of)|.{2,40} (?:for|of|on|in|to) the |[^.:]{3,60}: ?[^.:]{2,40}$|.{3,60} (?:19|20)\d\d$)", re.I)
_SENTENCE = re.compile(r"[。!?;]\s*$|[,。;]\s*\S|\.\s*$")
_CLOCK = re.compile(r"\d{1,2}:\d{2}")
_HEAD = re.compile(r"^\s*(?:第[一二三四五六七八九十\d]+[章节条]|[一二三四五六七八九十\d]{1,3}[、.](?!\d)|[((][一二三四五六七八九十\d]{1,3}[))]|【[^】]+】|part \d+\b|chapter \d+\b)", re.I)
_LISTED = re.compile(r"^\s*(?:[-*·•▪]\s|[((][一二三四五六七八九十\d]{1,3}[))])")
_CJK = re.compile("[㐀-鿿]")


#: What sets the items of a menu apart, and a line that nothing but furniture looks like at a margin.
_GAPS = re.compile(r"\s*[|｜·•]\s*|\s+[›»→]\s+|\s{2,}|\t+|　+")
_MARGINAL = re.compile(r"^\W*[©®↑▲△☰✉☎⌂»›←→]|\s[»›→]\s*$|\(\d+\)\s*$|^[^.:。：]{3,60}[?？]\s*$")
_CONTACT = re.compile(r"\d{3,}|\w@\w|X{3,}|^ {4}|\[[^\]]{3,}\]|联系|电话|邮箱|地点|时间|contact|phone|e-?mail|room\b|office hours|hours", re.I)
#: Ideographs or words of a line that can still be a link; letters of sentences that make a page's matter (an ideograph is two).
LINK_WIDE, LINK_WORDS, MATTER = 7, 5, 80
#: Characters of a line that is too long for a margin.
LONG = 120
#: Short lines whose forms are remembered: many stand in many pages.
REMEMBERED = 1 << 14


_ENDS = re.compile(r"[。.!！;；:：]\W*$")


def _says(line: str) -> bool:
    """Whether a line says something by itself: a sentence, a contact, opening hours, a numbered item or a row of a table."""
    return bool(_SENTENCE.search(line) or _CLOCK.search(line) or _CONTACT.search(line) or _FIELD.search(line) or _HEAD.match(line) or _LISTED.match(line) or line.count(" | ") >= 2)


def _items(line: str) -> int:
    """How many short items a line has that are set apart like links."""
    items = [key_of(i) for i in _GAPS.split(line.strip("[]【】·•|- \t\r"))]
    return len(items) if len(items) > 1 and all(0 < len(i) <= (10 if _CJK.search(i) else 24) for i in items) else 0


def _link_like(line: str, key: str) -> bool:
    if len(line) > LONG:
        return False
    if _OPEN.search(line):
        return False
    if _MARGINAL.search(line) or _items(line) >= 2:
        return len(key) <= 60
    return (len(key) <= LINK_WIDE if _CJK.search(line) else len(line.split()) <= LINK_WORDS) and not _says(line)


def _in_table(blocks: list[Block], i: int) -> bool:
    """Whether the line before or after has as many cells: rows of a table come together, menus alone."""
    cells = [b.line.count("|") + b.line.count("\t") for b in blocks[max(0, i - 1) : i + 2]]
    at = min(i, 1)
    return cells[at] > 0 and cells[at] in cells[:at] + cells[at + 1 :]


def _taken_up(key: str, rest: str) -> int:
    """How many of the title's short runs of letters stand in the rest of the page."""
    n = 2 if _CJK.search(key) else 5
    return sum(key[i : i + n] in rest for i in range(len(key) - n + 1))


def _tells(b) -> bool:
    """Whether a line is matter by its form: long, or a sentence."""
    return b.kind == TEXT and (len(b.line) > LONG or _short_tells(b.line, len(b.key)))


@lru_cache(REMEMBERED)
def _short_tells(line: str, letters: int) -> bool:
    if letters < 40:
        some = letters > LINK_WIDE if _CJK.search(line) else len(line.split()) > LINK_WORDS
        if not (some and _SENTENCE.search(line)):
            return False
    return not (_MARGINAL.search(line) or _items(line) >= 2)


def _mark_margins(blocks: list[Block], at: int, known: bool) -> int:
    """Marks what lies outside the matter; gives where the title stands, which is another place or none if it was taken for one.

    A page without sentences has no matter to be outside of; its lines stay what they are.
    """
    first, letters = -1, 0
    for i, b in enumerate(blocks):
        if _tells(b) and not (known and i == at):
            first = i if first < 0 else first
            letters += len(b.key) * (2 if _CJK.search(b.line) else 1)
            if letters >= MATTER:
                break
    else:
        return at
    taken: dict[int, int] = {}
    if not known and at >= first:
        at = -1  # a sentence
    elif not known and at >= 0:
        # the title isn't given: of the lines above the matter it is the one whose words the matter takes up
        rest = "".join(b.key for b in blocks if _tells(b))
        above = [i for i in range(first) if blocks[i].kind == TEXT and not (_items(blocks[i].line) >= 2 or _MARGINAL.search(blocks[i].line))]
        taken = {i: _taken_up(blocks[i].key, rest) for i in above}
        if not taken.get(at):
            at = max(above, key=lambda i: (taken[i], i), default=-1)
            if at >= 0 and not taken[at]:
                at = -1
    for i in range(first):
        b = blocks[i]
        if b.kind == TEXT and i != at and not taken.get(i) and _link_like(b.line, b.key) and not _in_table(blocks, i) and (i < at or at < 0 or _items(b.line) >= 2 and not _HEAD.match(b.line)):
            b.kind = MARGIN
    for i in range(len(blocks) - 1, first, -1):
        b = blocks[i]
        if b.kind == BLANK or b.kind in FURNITURE:
            continue
        if b.kind == TEXT and _link_like(b.line, b.key) and not _in_table(blocks, i):
            b.kind = MARGIN
        elif _ENDS.search(b.line) or _CLOCK.search(b.line) or _CONTACT.search(b.line) or _OPEN.search(b.line) or _HEAD.match(b.line) or _LISTED.match(b.line) or _in_table(blocks, i) or len(b.key) >= 40:
            break
    return at


def key_of(line: str) -> str:
    return _NOT_KEY.sub("", line.lower())


@lru_cache(1)
def _in_keys() -> np.ndarray:
    """Which code points of the basic plane stay in a key; line breaks do as well, so that keys can be told apart."""
    return np.array([c == 10 or not _NOT_KEY.match(chr(c)) for c in range(0x10000)])


def keys_of(lines: list[str]) -> list[str]:
    """key_of() each line, of all at once."""
    low = "\n".join(lines).lower()
    data = low.encode("utf-16-le", "surrogatepass")
    if len(data) == 2 * len(low):  # all of the basic plane
        codes = np.frombuffer(data, dtype="<u2")
        keys = codes[_in_keys().take(codes)].tobytes().decode("utf-16-le", "surrogatepass").split("\n")
        if len(keys) == len(lines):
            return keys
    return [key_of(line) for line in lines]


#: Characters that folding may change or leave out: all but some that it never does, next to any of their like.
_ODD = re.compile("[^\t\n -~·À-ÿ‐‒-—‘’“”•、-〃々-〩一-鿿]")
#: Different ones that are replaced one after another.
MOST_ODD = 24


@lru_cache(REMEMBERED)
def _fold(c: str) -> str | None:
    """What folding makes of a character whatever its neighbours are; None where it may depend on them (marks, parts of syllables)."""
    out = unicodedata.normalize("NFKC", c)
    if any(x > "\uffff" or "\u1100" <= x <= "\u11ff" or unicodedata.category(x)[0] == "M" for x in c + out):
        return None
    return _INVISIBLE.sub("", out)


def folded(text: str) -> str:
    odd = set(_ODD.findall(text))
    new = {c: _fold(c) for c in odd} if len(odd) <= MOST_ODD else {"": None}
    if None in new.values():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    else:
        for c, x in new.items():
            text = text.replace(c, x) if x != c else text
    return _STRAY.sub(" ", text) if "<" in text or "[" in text else text


class Block:
    """One line of the page: its number, the folded line, its key and its kind."""

    __slots__ = ("no", "line", "key", "kind")

    def __init__(self, no: int, line: str, key: str):
        self.no, self.line, self.key = no, line, key
        self.kind = TEXT if key else BLANK


#: Elements of markup that hold no matter.
SKIPPED = frozenset(("nav", "aside", "footer"))


def lines_of(text: str) -> list[str]:
    """The lines of a page, as given, or as rendered where the page is markup."""
    if _MARKUP.search(text):
        return html.render(html.build(text), skip=SKIPPED, code=True)
    return text.split("\n")


def _entry_like(line: str) -> bool:
    if len(line) > 90 or _CLOCK.search(line):
        return False
    if _DATED.search(line):
        return True
    bare = _BULLET.sub(" ", line.strip("·-*•▪»>【】[] \t\r")).strip()
    if _SENTENCE.search(bare) or _HEAD.match(bare):
        return False
    return bool((_ENTRY_ZH if _CJK.search(bare) else _ENTRY_EN).search(bare))


def _title_at(blocks: list[Block], title_key: str) -> int:
    """Where the page's own title stands: at its known wording, else at the first line that furniture doesn't explain."""
    if title_key:
        for i, b in enumerate(blocks):
            if b.kind == TEXT and b.key == title_key:
                return i
    candidates, inside = [], False
    for i, b in enumerate(blocks):
        if b.kind == BLANK:
            continue
        if b.kind == ASIDE:
            inside = True
        elif b.kind != TEXT:
            continue
        elif inside and _entry_like(b.line):
            candidates.append(i)
        elif candidates and (len(b.key) > 60 or _HEAD.match(b.line)):
            # entries run straight into the matter: the title is the entry whose subject the matter takes up again,
            # else the last one, unless it has a list's bullet or date
            rest = "".join(c.key for c in blocks[i:])

            def shared(j: int) -> float:
                k = blocks[j].key
                n = 4 if _CJK.search(k) else 9
                return sum(k[p : p + n] in rest for p in range(len(k) - n + 1))

            best = max(candidates, key=shared)
            if shared(best) >= 3:
                return best
            last = blocks[candidates[-1]].line.strip()
            return candidates[-1] if last[:1] not in "·-*•▪»" and not _DATED.search(last) else -1
        else:
            return i
    return -1


@lru_cache(REMEMBERED)
def _worded(line: str, k: str) -> str:
    """The kind of a line with the key k by its wording alone, TEXT if it says none."""
    m = _KEYED_RE.match(k)
    if m:
        return m.lastgroup
    if len(line) < 90 and _CRUMBS.match(line):
        return TRAIL
    if _NEIGHBOUR.match(line.lstrip("·-*•▪»> ")):
        return ENTRY
    if _ADDRESS.match(line):
        return FOOTER
    if k in _ASIDE:
        return ASIDE
    return MENU if _MENU.fullmatch(k) and not _FIELD.search(line) else TEXT


@lru_cache(REMEMBERED)
def _formed(line: str, letters: int) -> str:
    """The kind of a stripped line of the matter by its form."""
    if line.count(" | ") >= 2 or line.count("\t") >= 2:
        return ROW
    if _LISTED.match(line):
        return ITEM
    if _HEAD.match(line) and len(line) < 60 or (letters < (14 if _CJK.search(line) else 60) and not _SENTENCE.search(line) and not _CLOCK.search(line)):
        return HEADING
    return TEXT


def parse(text: str, title: str | None = None) -> list[Block]:
    """The blocks of a page, one for each line, each with its kind."""
    lines = lines_of(folded(text))
    blocks = [Block(i, line, key) for i, (line, key) in enumerate(zip(lines, keys_of(lines)), 1)]
    menu_run = []
    for b in blocks:
        if b.key and len(b.key) <= 130:
            b.kind = (_worded if len(b.line) <= LONG else _worded.__wrapped__)(b.line, b.key)
    # a menu word that stands alone, away from other furniture, is a heading of the matter
    solid = [b for b in blocks if b.kind != BLANK]
    for i, b in enumerate(solid):
        if b.kind == MENU and b.key in _MENU_WORD:
            near = [solid[j].kind for j in (i - 1, i + 1) if 0 <= j < len(solid)]
            if MENU not in near:
                menu_run.append((b, near))
    for b, near in menu_run:
        if not any(kind in FURNITURE for kind in near) or _HEAD.match(b.line):
            b.kind = TEXT
    name = key_of(folded(title)) if title else ""
    at = _title_at(blocks, name)
    at = _mark_margins(blocks, at, at >= 0 and blocks[at].key == name)
    inside = False
    for i, b in enumerate(blocks):
        if i == at:
            b.kind, inside = TITLE, False
        elif b.kind == ASIDE:
            inside = True
        elif b.kind == TEXT:
            if inside and _entry_like(b.line):
                b.kind = ENTRY
                continue
            inside = False
            line = b.line.strip()
            b.kind = (_formed if len(line) <= LONG else _formed.__wrapped__)(line, len(b.key))
        elif b.kind not in (BLANK, ENTRY, MARGIN):
            inside = False
    return blocks


def furniture(text: str | None, title: str | None = None) -> list[int]:
    """Numbers of the lines that are furniture; none of a null or blank text."""
    return [b.no for b in parse(text, title) if b.kind in FURNITURE] if text else []


def body(text: str, title: str | None = None) -> list[Block]:
    """The blocks of the page's own matter, without its title."""
    return [b for b in parse(text, title) if b.kind not in FURNITURE and b.kind not in (BLANK, TITLE)]


def _cells(line: str) -> list[str]:
    return [c.strip() for c in (line.split("\t") if "\t" in line else line.strip(" |").split("|"))]


def matter(text: str | None, title: str | None = None) -> str | None:
    """The text with its furniture left out, gaps kept to one blank line and tables aligned; null stays null."""
    if text is None:
        return None
    markup = bool(_MARKUP.search(text))
    blocks = parse(text, title)
    raw = [b.line for b in blocks] if markup else text.split("\n")
    out, i, gap = [], 0, False
    while i < len(blocks):
        b = blocks[i]
        if b.kind == BLANK:
            gap = bool(out)
        elif b.kind not in FURNITURE:
            if gap:
                out.append("")
            gap = False
            if b.kind == ROW:
                j = i
                while j < len(blocks) and blocks[j].kind == ROW:
                    j += 1
                rows = [_cells(raw[r]) for r in range(i, j)]
                widths = [max(len(r[c]) for r in rows if len(r) > c) for c in range(max(map(len, rows)))]
                out.extend(" | ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)
                i = j
                continue
            out.append(raw[i].rstrip("\r \t　\xa0"))
        i += 1
    return "\n".join(out)
