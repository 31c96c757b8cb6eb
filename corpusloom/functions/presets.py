"""Patterns and word lists, one preset for Chinese legal texts and one for Latin-script prose."""

from __future__ import annotations

from dataclasses import dataclass, field

# The Chinese preset's delimiters, patterns and markers, and the garbled-text markers.
MOJIBAKE_MARKERS = ("锟斤拷", "�", "Ã", "æ", "å", "ð")
ZH_DELIMITERS = "。！？；"
ZH_HINTS = r"(第[一二三四五六七八九十百千0-9]+[条章节编款项]|一、|二、|三、|\([一二三四五六七八九十]\))"
ZH_HEADING = r"(第[一二三四五六七八九十百千0-9]+编|第[一二三四五六七八九十百千0-9]+章|第[一二三四五六七八九十百千0-9]+节|第[一二三四五六七八九十百千0-9]+条|第[一二三四五六七八九十百千0-9]+款|第[一二三四五六七八九十百千0-9]+项|[一二三四五六七八九十]+、|（[一二三四五六七八九十0-9]+）)"
ZH_ARTICLE = r"(第[一二三四五六七八九十百千万零〇两\d]+条)"
ZH_DEFINITION = r"([^，,。；]{2,24}?)(?:，|,)?是指"
ZH_SECONDARY = r"(?<=[。！？；])|(?<=，)|(?<=:)|(?<=：)"
ZH_RESPONSIBILITY = ("负责", "监督管理", "承担", "应当对", "由", "主管")
ZH_ACTOR = ("由", "负责", "监督管理")
ZH_PAIR = r"分为([^，,。；]{1,12}?)(?:、|和|与)([^，,。；]{1,12}?)(?:两类|两种|两级|两部分)"
ZH_PAIRS = (("A类", "B类"), ("一级专名", "二级专名"))
ZH_PLACEHOLDERS = ("什么什么", "某某", "XXX", "……")
ZH_CONDITION = ("应当具备", "具备下列条件", "有下列情形之一", "符合下列条件", "满足下列条件", "方可", "可以申请")
ZH_PROCEDURE = ("申请", "提交", "受理", "审查", "审核", "补正", "通知", "办理")


@dataclass(frozen=True)
class Preset:
    """What depends on the script of the texts."""

    delimiters: str
    hints: str
    heading: str
    levels: tuple[str, ...]
    article: str
    definition: str
    condition: tuple[str, ...]
    procedure: tuple[str, ...]
    responsibility: tuple[str, ...]
    actor: tuple[str, ...]
    pair: str
    pairs: tuple[tuple[str, str], ...] = ()
    placeholders: tuple[str, ...] = ("??", "__", "TODO")
    secondary: str = r"(?<=[,:;])"
    token: str = r"[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]"
    boilerplate: tuple[str, ...] = field(default=())
    #: What every match of definition has.
    definition_mark: str = ""


ZH = Preset(ZH_DELIMITERS, ZH_HINTS, ZH_HEADING, ("编", "章", "节", "条", "款", "项"), ZH_ARTICLE, ZH_DEFINITION, ZH_CONDITION, ZH_PROCEDURE, ZH_RESPONSIBILITY, ZH_ACTOR, ZH_PAIR, ZH_PAIRS, ZH_PLACEHOLDERS, ZH_SECONDARY, definition_mark="是指")
LATIN = Preset(
    delimiters=".!?;\n",
    hints=r"([A-Z][a-z]+\.)",
    heading=r"(\n[A-Z][a-z]*\.)",
    levels=("\n",),
    article=r"(\n)",
    definition=r"([a-z]{2,24}) is ",
    condition=("that", "que", "der"),
    procedure=("tion", "ment", "keit"),
    responsibility=("by ", "par ", "von "),
    actor=("by ", "par "),
    pair=r"both ([a-z]{1,12}) and ([a-z]{1,12})",
    pairs=(("the", "and"), ("le", "et")),
    definition_mark=" is ",
)
