"""Problem 4: template residue, filler, error pages and script notices that stand where the matter should be.

Unfilled placeholders are found with one small grammar for each kind of delimiter.  Pages *about* templates and errors
hold them too, so three surroundings discount what they hold:

* code blocks (fences, <pre> and <code>, blocks set in behind a colon), if the page has prose of its own around them,
* lines that a teaching line introduces ("the template looks like this:"), and what stands in quotation marks, between
  backticks or after words such as "for example",
* teaching prose that names few fields in many words (density).

Discounted lines count as matter.  Filler is known by
its vocabulary or by saying the same thing over and over; error and script notices by their wording, in lines that hold
nothing else.  A page is a case when such lines make up at least ``share`` of its matter, that is of the text without
furniture and title: one open detail in a real page, or a script notice in its margin, stays far below.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from lectern.llm import page
from lectern.llm.batches import per_text

#: delimiter -> grammar of a field that nobody filled in
PLACEHOLDERS = {
    "double braces": r"\{\{\s*[\w.\- ]{1,40}\s*\}\}",
    "dollar braces": r"[$#]\{\s*[\w.]{1,40}\s*\}",
    "percent signs": r"%[A-Z][A-Z_0-9]{1,30}%",
    "underscores": r"__[A-Z][A-Z_0-9]*?__",
    "guillemets": r"«[^\W\d_][\w ]{0,28}»",
    "angle brackets": r"<[A-Z][A-Z_ ]{1,30}>",
    "template tags": r"<%=?[^%\n]{1,60}%>|\{%[^%\n]{1,60}%\}",
    "square brackets": r"\[(?:insert|enter|your|add|此处|在此|请填|请输入|填写|插入)[^\]\n]{0,40}\]|\[[^\]\n]{1,30}(?:TBC|TBD|TBA|待填|待定|待补充)\]",
    "lenticular brackets": r"【[^】\n]{0,20}(?:待填|待定|待补充|填写)[^】\n]{0,10}】",
    "crosses": r"(?<![A-Za-z0-9])X{3,}(?![A-Za-z0-9])",
}
_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS.values()))
_QUOTED = re.compile(
    r"[“”\"'‘’「」『』`][^“”\"'‘’「」『』`\n]{0,3}(?:%s)[^“”\"'‘’「」『』`\n]{0,3}[“”\"'‘’「」『』`]"
    r"|(?:such as|like|for example|e\.g\.|例如|比如|形如|诸如)\s*(?:%s)(?:\s*(?:or|and|,|、|或|和|与)\s*(?:%s))*" % ((_PLACEHOLDER.pattern,) * 3),
    re.I,
)

#: Words of lines that teach: how templates, programs and their messages look.
TEACHING = """placeholder placeholders template templates variable variables syntax tutorial example examples instance snippet replaced replaces substituted rendered renders
code log logs trace traceback console output configuration troubleshooting merge 占位符 模板 模版 变量 语法 示例 举例 例子 教程 替换 代码 日志 报错 配置 渲染 控制台 输出 排查""".split()
_TEACHING = re.compile("|".join(rf"\b{w}\b" if w.isascii() else w for w in TEACHING), re.I)
_FENCE = re.compile(r"\s*(?:```|~~~)")
_OPEN, _CLOSE = re.compile(r"<(?:pre|code)\b[^>]*>", re.I), re.compile(r"</(?:pre|code)>", re.I)
_SET_IN = re.compile(r"(?: {4,}|\t+)\S")
_INTRODUCES = re.compile(r"[:：]\s*$")
#: Letters of prose for each of code that a page must have for its code blocks to be discounted, and of words for each of a field.
PROSE, WORDS = 0.2, 3

FILLER_WORDS = """lorem ipsum dolor sit amet consectetur adipiscing elit turpis porta cordis orna ornare sagitta sagittis ligula
viverra quisque parum domus nullam fringa fringilla tempor augue mattis vestra vestibulum ferme asdf qwer qwerty foo bar baz
dummy test aaa bbb xxx text sample demo 123 1234 abc""".split()
_FILLER = frozenset(FILLER_WORDS)
_FILLER_PHRASE = re.compile(
    r"占位(?:文本|文字|内容)|样例段落|示例(?:文本|段落)|段落文字|在此(?:输入|添加)|测试测试|(?:正文){3}|replace this text|your (?:own )?text here|text goes here"
    r"|sample (?:paragraph|text)|placeholder (?:text|content)|lorem ipsum",
)
#: Each of these phrases holds one of these.
_FILLER_SIGNS = ("text", "paragraph", "content", "lorem ipsum", "占位", "样例段落", "示例", "段落文字", "在此", "测试测试", "正文正文")
_MARKS = re.compile(r"[{%_«<\[【X]")
_UNIT = re.compile(r"[^。.!!??,,、;;\s]+")
_LOOPED = re.compile(r"(.{2,12}?)[。.,, ]?(?:\1[。.,, ]?){3,}")

#: On lines in lower case.
_NOTICES = re.compile(
    r"^\W*(?:http\s*)?[45]\d\d\s*(?:[-:]\s*)?(?:页面|网关|服务|禁止|资源|请求|内部|错误|未找到|无法|not found|forbidden|bad |gateway|internal|service|gone|unavailable|error|unauthorized)"
    r"|错误代码\s*\d|(?:操作失败|出错了|系统提示|系统错误|访问出错|页面不存在)\W*$|something went wrong|service unavailable|query failed near|request id \w|stack trace"
    r"|数据库连接|连接(?:失败|超时|错误)|已通知(?:值班|管理|维护)|^\W*at [\w.$]+\([\w .]+:\d+\)|^\W*(?:[a-z_]\w*\.)+\w*(?:exception|error)\b|scripts? (?:are|is) (?:blocked|disabled|off)"
    r"|session expired|^\W*(?:fatal |parse |php )?(?:warning|error|exception|traceback)\b\s*[:(]"
    r"|(?:文章|页面|内容|信息|资源)(?:已被?|已经)(?:删除|移除|下线|关闭)|正在检查您的浏览器|完成后将自动跳转|checking your browser"
    r"|requested (?:address|page|url|resource)|(?:请求|访问)的(?:资源|页面|地址|内容)|很遗憾,?地址|\d+\s*秒后(?:自动)?(?:返回|跳转)|请检查链接|返回(?:上一页|首页)\W*$"
    r"|oops\b|page (?:is )?missing|page (?:was )?not found|return to the home ?page|try again later|稍后(?:再试|重试)|take a few seconds|联系管理员|contact the administrator|check the (?:address|link)"
    r"|(?:您的)?浏览器(?:禁用了|不支持|版本过低|已禁用)|(?:需要|请|要求).{0,6}(?:启用|开启|打开|支持).{0,4}(?:javascript|脚本)|(?:脚本|javascript)支持才能|刷新本?页面|重新加载"
    r"|javascript is (?:required|disabled)|(?:enable|turn on|activate) javascript|without javascript|^\W*loading\b.{0,40}\.\.\.|加载中|正在加载|请稍候|please wait"
    r"|建设中|敬请期待|正在更新|coming soon|under construction|more to come|即将上线|content (?:to follow|pending)|暂无内容|页面维护|正在维护|系统(?:维护|升级)中|网站(?:维护|升级)中|访问被拒绝|权限不足|(?:没有|无)(?:查看|访问)?权限|会话(?:已)?(?:过期|超时)|网络(?:异常|错误)|服务(?:异常|不可用)|(?:文件|资源|页面|网页)(?:不存在|丢失|已失效)|链接已(?:失效|过期)|此处内容"
    r"|access denied|permission denied|timed? ?out|bad request|unexpected error|error (?:has )?occurred|verify (?:that )?you are|are you (?:a )?(?:human|robot)|cannot be displayed"
    r"|(?:has been|was) (?:removed|deleted|moved)|no longer available|does not exist|(?:database|internal|server) error|stay tuned|under maintenance|temporarily unavailable|nothing (?:here|to see)",
)
_QUOTES = re.compile(r"[“\"「『‘][^“”\"「」『』‘’]{1,60}[”\"」』’]|(?<=\s)'[^']{1,60}'(?=[\s,.;])")
#: A notice line says little besides; matter that mentions a notice is longer.
NOTICE_CHARS = 90


def _filler(line: str, low: str) -> bool:
    if len(set(line[:120])) > 45:
        return False
    letters = set(line)
    if len(letters) > 45:  # what repeats itself makes do with few characters
        return False
    phrase = _FILLER_PHRASE.search(low) if any(sign in low for sign in _FILLER_SIGNS) else None
    if phrase and (len(line) <= 120 or low.count(phrase.group(0)) >= 3):
        return True
    words = low.split()
    if len(words) >= 8 or not page._CJK.search(line):  # words set apart by spaces
        names = [w.strip(".,;:!?()") for w in words]
        if len(names) >= 2 and sum(map(_FILLER.__contains__, names)) >= 0.5 * len(names):
            return True
        return len(names) >= 8 and len(set(names)) <= 0.35 * len(names)
    if len(letters) > 0.45 * len(line):
        return False
    units = _UNIT.findall(line)
    if len(units) >= 6 and len(set(units)) <= len(units) // 3:
        return True
    return len(line) <= 2000 and sum(len(m.group(0)) for m in _LOOPED.finditer(line)) >= 0.5 * len(line)


def _teaches(line: str) -> bool:
    """Whether the line is prose about fields rather than a line whose fields are open: it says so, in many more words."""
    bare = _PLACEHOLDER.sub(" ", line)
    return bool(_TEACHING.search(bare)) and len(page.key_of(bare)) >= WORDS * (len(page.key_of(line)) - len(page.key_of(bare)))


def kind_of(line: str) -> str | None:
    """placeholder, filler, notice or None: what a folded line of the matter is a remnant of."""
    return (_kind_of if len(line) <= page.LONG else _kind_of.__wrapped__)(line.strip())


@lru_cache(page.REMEMBERED)
def _kind_of(line: str) -> str | None:
    if _MARKS.search(line) and _PLACEHOLDER.search(line) and _PLACEHOLDER.search(_QUOTED.sub(" ", line)) and not _teaches(line):
        return "placeholder"
    low = line.lower()
    if len(line) <= NOTICE_CHARS and _NOTICES.search(low) and _NOTICES.search(_QUOTES.sub(" ", low)):
        return "notice"
    return "filler" if _filler(line, low) else None


def _code(blocks: list[page.Block]) -> list[bool]:
    """Which lines stand in a code block: between fences or tags (to the end where none closes), or set in behind a colon."""
    if not any("<" in b.line or "```" in b.line or "~~~" in b.line or b.line.startswith(("    ", "\t")) for b in blocks):
        return [False] * len(blocks)
    out, inside, set_in, before = [], "", False, ""
    for b in blocks:
        line = b.line
        if inside:
            out.append(True)
            if _FENCE.match(line) if inside == "fence" else _CLOSE.search(line):
                inside = ""
            continue
        opened = _OPEN.search(line)
        if _FENCE.match(line):
            inside = "fence"
        elif opened and not _CLOSE.search(line, opened.end()):
            inside = "tag"
        set_in = bool(_SET_IN.match(line)) and (set_in or bool(_INTRODUCES.search(before)))
        out.append(bool(inside or opened or set_in))
        if line.strip():
            before = line
    return out


def verdict(blocks: list[page.Block]) -> tuple[float, str | None]:
    """The share of the matter that is residue, and its prevailing kind.

    Shares are of letters and digits.  Of placeholders the share of the lines counts where that is more: a form letter
    whose facts are open stays one, however long the sentences between its fields are.
    """
    code = _code(blocks)
    rows = [(b, code[i], kind_of(b.line)) for i, b in enumerate(blocks) if b.kind not in page.FURNITURE or code[i]]
    if not any(kind for _, _, kind in rows):
        return 0.0, None
    prose = sum(len(b.key) for b, in_code, kind in rows if not in_code and kind is None and b.kind not in (page.TITLE, page.HEADING, page.BLANK))
    explained = prose >= PROSE * sum(len(b.key) for b, in_code, _ in rows if in_code)
    total = found = lines = fields = 0
    by: dict[str, int] = {}
    introduced = False
    for b, in_code, kind in rows:
        if b.kind == page.BLANK:
            continue
        if kind is None:
            introduced = bool(_INTRODUCES.search(b.line) and _TEACHING.search(b.line))
        discounted = (in_code and explained) or (kind is not None and introduced)
        if kind is not None and discounted:
            kind = None
        n = len(b.key)
        if kind is None and b.kind == page.TITLE:
            continue
        if kind is None and b.kind == page.HEADING and not discounted:
            n = min(n, 4)
        else:
            lines += 1
        total += n
        if kind:
            found += n
            by[kind] = by.get(kind, 0) + n
            fields += kind == "placeholder"
    if not found:
        return 0.0, None
    return max(found / total, fields / lines if fields >= 3 else 0.0), max(by, key=by.get)


def residue_share(text: str | None, title: str | None = None) -> tuple[float, str | None]:
    """verdict() of a text; (0, None) of null, empty and blank texts."""
    return verdict(page.parse(text, title)) if text and text.strip() else (0.0, None)


#: The least share of residue of a case.  Real pages stay under a tenth, cases over a half, so that the place between matters little.
SHARE = 0.4


def residues(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = "title", share: float = SHARE) -> DataFrame:
    """(id, residue, share) of the documents that are residue.

    Null, empty and blank texts have none; a null title is as good as no title column.  Repeated rows come out as often
    as they stand in the input; other columns are never read.
    """

    def found(text, title):
        score, kind = residue_share(text, title)
        return [(kind, score)] if score >= share else []

    return per_text(docs, found, id_col, text_col, title_col, "residue string, share double")
