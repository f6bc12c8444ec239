"""Problem 5: personal information in free text.

Candidate gradient boosting. Generators with high recall propose spans, which may overlap: runs of digits in any script as
phone and identity numbers, addresses from street names and house numbers, mailboxes with spelt-out signs, and every family
name with one or two characters after it. Boosted trees, one set for each kind, weigh features of the format (lengths, dates,
check digits, prefixes) and of the context (what stands before and after). They are fitted on texts that the templates below
make (seeded; ``examples`` of them); each kind's threshold is chosen on templates' texts left out. Of overlapping spans that
pass, the more probable is redacted.

Detection sees each character in half width; characters without form are passed over. All other text stays as it is.
"""

from __future__ import annotations

import datetime
import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.boosting import Boosted

#: Different texts whose redacted form a task keeps, since texts of logs come again.
KNOWN = 100_000
KINDS = ("email", "phone", "id_number", "address", "name")

# Family names, the compound ones after them.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉骆蓝路游辛靳欧管柴蒙鲍华喻祁蒲房滕屈饶解牟艾尤阳时穆农司卓古吉缪简车项连芦麦褚娄窦戚岑景党宫费卜冷晏席卫米柏宗瞿桂全佟应臧闵苟邬边卞姬师和仇栾隋商刁沙荣巫寇桑郎甄丛仲虞敖巩明佘池查麻苑迟邝封凤束燕冼"
COMPOUND = ("欧阳", "司马", "上官", "诸葛", "夏侯", "皇甫", "尉迟", "公孙", "慕容", "令狐", "司徒", "东方", "端木", "南宫")
# Characters that hardly stand in a given name, since they are grammar or trade.
NOT_GIVEN = frozenset("的了吗呢吧是不有在要我你他她它们这那哪什么怎多少几个和与或及但而就都也还很太更最能会可以应该请把被让给对从到向于为因所如果则再又先后前上下里外内中间旁边装修改换补做铺贴刷打拆查验收付款签字费单表图卡证号码话机师傅工程监理经理员队组厂商部门窗地板墙面顶砖瓷柜管线灯水电气油漆木石材料价格元米平方厚度尺寸温湿高低大小长宽快慢新旧坏漏裂空鼓起泡返潮发黄霉堵塞松动变形色差读数日时分周期路街道巷区市省县镇村栋幢室楼层单元座称总先生女士老板客服微信")
_TRADE = ("师傅", "经理", "监理", "助理", "厂家", "管家", "司机", "班组", "邻居", "专员", "队", "员", "师", "商", "厂", "长", "班长", "家人", "朋友", "同事", "杂工")
_NAME_LABEL = ("业主", "户主", "收件人", "收货人", "联系人", "姓名", "名字", "抬头", "签的是", "付款人是", "人是", "业主是", "本人", "签收人", "负责人", "申请人", "叫", "我是", "客户", "住户", "租客", "房东", "name is", "name:", "i am", "信息", "登记", "业主为", "经办人", "付款人", "署名", "名叫", "业主叫")
_NAME_VERB = ("找", "请", "转", "委托", "为", "给", "查下", "查一下", "来的", "上的", "由", "问", "联系", "通知", "让", "请转", "转给", "发给", "交给", "寄给", "叫做", "和", "与", "跟", "写着", "写的", "写的是", "那位", "是")
_NAME_AFTER = ("说", "带", "那户", "登记", "验收", "签", "确认", "不", "先", "来", "在", "本人", "收", "的", "和", "与", "家", "这户", "已", "没", "要", "想", "把", "反映", "表示", "电话", "手机", "身份证", "你好", "您好")
_TITLE = ("先生", "女士", "工", "总", "师傅", "经理", "老师", "监理", "老板", "小姐", "太太", "姐", "哥", "师")
_PHONE_CUE = re.compile(r"(电话|手机|回电|号码|联系方式|致电|拨打|打我|还是打|请打|打给|微信|同号|电联|来电|热线|座机|联系|保持|登记|tel|phone|call|mobile|whatsapp|contact)[^\d]{0,6}$", re.I)
_ID_CUE = re.compile(r"(身份证|证件|身份证号|身份号码|证号|id|identity|居民证)[^\d]{0,6}$", re.I)
_ORDER_CUE = re.compile(r"(订单|批号|合同|编号|单号|运单|账号|卡号|型号|读数|规范|条码|流水|工单|货号|序列|批次|order|batch|ref|no|sku|lot|快递)\S{0,3}[^\d]{0,3}$", re.I)
_ADDRESS_CUE = re.compile(r"(住|住在|地址|寄|寄到|寄往|送货到|送到|搬到|位于|到|从|去|家在|在|找不到|根据|地址是|address|live at|ship to|deliver to)[^\w]{0,3}$", re.I)
_DIGITS_ZH = str.maketrans("零〇一二三四五六七八九幺两壹贰叁肆伍陆柒捌玖", "0012345678912" + "123456789")
_D = "0-9零〇一二三四五六七八九幺"
_SEP = r"[ \-.·_—–~－]"

_GROUP = re.compile(rf"[{_D}]+[xX]?(?![A-Za-z])|[{_D}]+")
_JOINED_LEFT = re.compile(rf"(?:[{_D}]+[xX]?{_SEP}{{1,2}})+$")
_JOINED_RIGHT = re.compile(rf"^(?:{_SEP}{{1,2}}[{_D}]+[xX]?)+")
_JOINT = re.compile(rf"{_SEP}{{1,2}}|[()]|[()]{_SEP}|{_SEP}[()]")
_IDENTITY = r"[1-8]\d{5}(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dxX]"
_TILES = re.compile(rf"(?:{_IDENTITY}|(?:86)?1[3-9]\d{{9}}){{2,}}")
_TILE = re.compile(rf"({_IDENTITY}|(?:86)?1[3-9]\d{{9}})")
_INNER_ID = re.compile(rf"(?=({_IDENTITY}))")
_JOINTS = frozenset(" -.·_—–~－")
_NOT_DIGIT = re.compile("[^0-9xX]")
_ASCII_DIGIT = re.compile("[0-9xX]")
_DIGIT = re.compile(rf"[{_D}xX]")
_DIGITS = re.compile(rf"[{_D}xX]+")
_MOBILE = re.compile(r"1[3-9]\d{9}")
_LANDLINE = re.compile(r"0(?:10|2\d|[3-9]\d{2})[2-8]\d{6,7}")
_SERVICE = re.compile(r"[48]00\d{7}")
_DATED = re.compile(r"(?:19|20)\d\d[- ./]\d{1,2}[- ./]\d{1,2}")
_TWO_DIGITS = re.compile(rf"[{_D}]{_SEP}?[{_D}]")
_ANY_DIGIT = re.compile(rf"[{_D}]")
_DOT = r"(?:\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}|点)\s*|\s+dot\s+|\s?[.。．。]\s?)"
_AT_SIGN = r"\s*(?:@|\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|艾特|#at#)\s*"
_AT = rf"(?:{_AT_SIGN}|\s+at\s+)"
_EMAILS = [re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+\-]*{at}[A-Za-z0-9][A-Za-z0-9\-]*(?:{_DOT}[A-Za-z][A-Za-z0-9\-]*)+", re.I) for at in (_AT_SIGN, r"\s+at\s+")]
_HOUSE = rf"[{_D}十百]{{1,6}}(?:[\-－之][{_D}]{{1,5}})?"
_MORE = rf"(?:\s*[{_D}]{{1,4}}(?:[\-－][{_D}]{{1,5}}){{1,3}})?(?:\s*(?:[一-鿿]{{2,6}}(?:里|坊|园|居|苑|府|湾|庭|城|庄|轩|阁|小区|公寓|花园|家园|大厦))?\s*(?:[{_D}A-Za-z]{{1,5}}\s*(?:号楼|栋|幢|座|单元|室|层|楼|户|号)|[\-－][{_D}]{{1,5}}))*(?:\s*[{_D}]{{2,5}}(?![{_D}]))?"
_ADDRESS = re.compile(rf"(?:[一-鿿]{{1,7}}(?:省|市|自治区))?(?:[一-鿿]{{1,7}}(?:区|县|镇|乡))?[一-鿿]{{1,8}}?(?:大街|大道|胡同|路|街|道|巷|弄|里弄)(?:[东西南北中]段)?\s*{_HOUSE}\s*(?:号院|号|弄){_MORE}")
_ADDRESS_EN = re.compile(r"(?:(?:Flat|Apt|Apartment|Unit|Room|Suite)\.?\s*\d+\w?\s*,\s*)?\d{1,5}\w?\s+(?:[A-Z][a-z]+\s+){1,3}(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Way|Close|Boulevard|Blvd|Place|Square|Terrace)(?![A-Za-z])\.?(?:\s*,\s*(?:Flat|Apt|Apartment|Unit|Room|Suite)\.?\s*\d+\w?)?")
_STREET, _STREET_EN = re.compile("[路街道巷弄]|胡同"), re.compile(r"\d\w? +[A-Z]")
_NAME_EN = re.compile(r"(?<![A-Za-z])([A-Z][a-z]{1,14}(?:[ ·][A-Z]\.)?[ ·][A-Z][a-z]{1,15})(?![A-Za-z])")
# In one case only, a name is looked for after a label.
_NAME_ANY_CASE = re.compile(r"(?:\bname(?: is|:| :)|\bi am|\bi'm|\bthis is|\bask for|姓名|联系人|收件人|收货人|业主|户主|抬头)[ ::]*(?:是[ ::]*)?((?:[a-z]{2,15}|[A-Z]{2,15})[ ·](?:[a-z]{2,16}|[A-Z]{2,16}))(?![A-Za-z])", re.I)
_NAME_END = re.compile(r"\s*(?:[^\w\s]|$|\d|[一-鿿]|(?:and|from|at|on|phone|tel|email|mobile|of|here)\b)", re.I)
_LATIN_WORD = re.compile(r" ?([A-Za-z]+)?")
_HOUSE_BEFORE = re.compile(r"\d+\w?\s*$")
_CODE_AFTER = re.compile(r" [A-Z]{1,3}\d")
_LABELLED = re.compile(r"(?:业主|户主|收件人|收货人|联系人|姓名|签收人|申请人|经办人|付款人|名叫)(?:姓名|信息)?(?:是|为|叫)?[ ::]*")
_NOT_NAME_EN = frozenset("street road lane avenue drive court way close boulevard place square terrace flat apt apartment unit room suite my the please keep ask before after at do our if once leave hello dear thanks note best first second order batch main floor water new no how what when where which who why is are can north south east west".split())
_SURNAME = frozenset(SURNAMES)
_RANK = {c: min(SURNAMES.find(c), 239) // 20 for c in SURNAMES}
_THIS_YEAR = str(datetime.date.today().year)
_FAMILY = re.compile(rf"(?=({'|'.join(COMPOUND)}|[{SURNAMES}]))")


@dataclass(slots=True)
class Span:
    kind: str
    start: int
    end: int
    features: list[int]
    p: float = 0.0


class _HalfWidth(dict):
    """For ``str.translate``: a character's one in half width; None for one without form. Filled as characters come."""

    def __missing__(self, code: int) -> int | None:
        ch = chr(code)
        to: int | None = code
        if code in (0xA0, 0xAD) or code >= 0x2000 and not 0x4E00 <= code <= 0x9FFF:
            kind = unicodedata.category(ch)
            if 0xFF01 <= code <= 0xFF5E:
                to = code - 0xFEE0
            elif kind == "Cf":
                to = None
            elif kind == "Zs":
                to = 32
            elif len(n := unicodedata.normalize("NFKC", ch)) == 1:
                to = ord(n)
        self[code] = to
        return to


_HALF_WIDTH = _HalfWidth()


def _view(text: str) -> tuple[str, range | list[int]]:
    """The text in half width without invisible characters, and each character's place in the text."""
    if text.isascii():
        return text, range(len(text) + 1)
    view = text.translate(_HALF_WIDTH)
    if len(view) == len(text):
        return view, range(len(text) + 1)
    return view, [*(k for k, ch in enumerate(text) if _HALF_WIDTH[ord(ch)] is not None), len(text)]


def _han(ch: str) -> bool:
    return "一" <= ch <= "鿿"


def _edge(ch: str) -> int:
    """0 none, 1 mark, 2 blank, 3 digit, 4 Latin letter, 5 Han or other."""
    if not ch:
        return 0
    if ch.isspace():
        return 2
    if ch.isdigit():
        return 3
    if ch.isascii() and ch.isalpha():
        return 4
    return 5 if ch.isalnum() else 1


def _check_digit(d: str) -> bool:
    if len(d) != 18 or not d[:17].isdigit():
        return False
    return "10X98765432"[sum(int(c) * pow(2, 17 - k, 11) for k, c in enumerate(d[:17])) % 11] == d[17].upper()


def _date(d: str) -> bool:
    return d.isdigit() and len(d) == 8 and "1900" <= d[:4] <= _THIS_YEAR and "01" <= d[4:6] <= "12" and "01" <= d[6:] <= "31"


def _digit_runs(v: str) -> Iterator[tuple[int, int, int, int]]:
    """Every run of one to five neighbouring groups of digits, with a plus before it: start, end, number of digits, and whether it is a tile.

    A group of more than 20 digits is cut into tiles where it is made of numbers written without a gap; of any other such group, the
    parts that look like identity numbers are given.
    """
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(v)]
    for k, (start, end) in enumerate(groups):
        if end - start > 20:
            plain = v[start:end].translate(_DIGITS_ZH)
            tiled = _TILES.fullmatch(plain)
            for m in (_TILE if tiled else _INNER_ID).finditer(plain):
                x, y = m.span(1)
                yield start + x, start + y, y - x, 1 + bool(tiled)
            continue
        if start and v[start - 1] == "+":
            start -= 1
        total = 0
        for j in range(k, min(k + 5, len(groups))):
            if j > k and not _JOINT.fullmatch(v, groups[j - 1][1], groups[j][0]):
                break
            total += groups[j][1] - groups[j][0]
            if total > 20:
                break
            if total >= 7:
                yield start, groups[j][1], total, 0


@lru_cache(maxsize=1 << 16)
def _number_left(left: str) -> tuple[list[int], int, int]:
    """Of up to 26 characters before a number: the cues, the edge, and the number of digits that go on beyond a joint."""
    near = left[-12:]
    m = _JOINED_LEFT.search(left) if left[-1:] in _JOINTS else None
    return [int(bool(c.search(near))) for c in (_PHONE_CUE, _ID_CUE, _ORDER_CUE)], _edge(left[-1:]), min(len(_DIGIT.findall(m.group())), 19) if m else 0


@lru_cache(maxsize=1 << 16)
def _number_right(right: str) -> tuple[int, int]:
    m = _JOINED_RIGHT.search(right) if right[:1] in _JOINTS else None
    return _edge(right[:1]), min(len(_DIGIT.findall(m.group())), 19) if m else 0


def _numbers(v: str) -> Iterator[Span]:
    for start, end, total, tile in _digit_runs(v):
        raw = v[start:end]
        digits = raw if raw.isascii() and raw.isdigit() else _NOT_DIGIT.sub("", raw.translate(_DIGITS_ZH))
        intl = raw.startswith(("+", "00"))
        core = digits
        for prefix in ("0086", "86"):
            if core.startswith(prefix) and len(core) - len(prefix) in (10, 11) and (intl or core[len(prefix)] == "1"):
                core = core[len(prefix) :]
                break
        phone, identity = 7 <= len(core) <= 13 and core.isdigit(), 15 <= len(core) <= 18
        if not phone and not identity:
            continue
        cues, edge, joined = _number_left(v[max(0, start - 26) : start])
        edge_right, joined_right = _number_right(v[end : end + 26])
        around = [*cues, edge, edge_right, joined, joined_right]
        zh = 0 if raw.isascii() else total - len(_ASCII_DIGIT.findall(raw))
        seps = len(raw) - total
        if phone:
            groups = [len(x) for x in _DIGITS.findall(raw)]
            mobile = int(bool(_MOBILE.fullmatch(core)))
            land = int(bool(_LANDLINE.fullmatch(core)))
            service = int(bool(_SERVICE.fullmatch(core)))
            dated = int(len(core) <= 8 and bool(_DATED.match(raw)))
            decimal = int("." in raw and seps == 1)
            yield Span("phone", start, end, [len(core), mobile, land, service, int(intl), min(seps, 6), min(zh, 12), *around, dated, decimal, int(core[0]), max(groups), min(len(groups), 5), tile])
        if identity:
            region = int(core[:2].isdigit() and 11 <= int(core[:2]) <= 82)
            yield Span("id_number", start, end, [len(core), region, int(_date(core[6:14])), int(_check_digit(core)), int(core[-1] in "xX"), min(seps, 6), min(zh, 18), *around, int(core[0]) if core[0].isdigit() else 0, int(_date("19" + core[6:12])), tile])


def _emails(v: str) -> Iterator[Span]:
    for m in (m for pattern in _EMAILS for m in pattern.finditer(v)):
        raw = m.group()
        local, _, domain = re.split(f"({_AT})", raw, maxsplit=1, flags=re.I)[:3]
        sign = re.search(_AT, raw, re.I).group().strip().lower()
        tld = re.split(_DOT, domain, flags=re.I)[-1]
        f = [int(sign == "@"), int(sign == "at"), int(sign[:1] in "[({"), min(len(local), 20), min(len(domain), 30), min(len(tld), 10), int(any(c.isdigit() for c in local)), int(any(c in "._-+" for c in local)), _edge(v[m.start() - 1 : m.start()] if m.start() else ""), _edge(v[m.end() : m.end() + 1]), int(" dot " in raw.lower()), int(domain.islower() or domain.isupper()), min(raw.count(" "), 6)]
        yield Span("email", m.start(), m.end(), f)


def _addresses(v: str) -> Iterator[Span]:
    for pattern, english, gate in ((_ADDRESS, 0, _STREET), (_ADDRESS_EN, 1, _STREET_EN)):
        if not gate.search(v):
            continue
        for m in pattern.finditer(v):
            raw, start = m.group(), m.start()
            left = v[max(0, start - 6) : start]
            if not english:  # words that lead in stand before the name of the place
                lead = re.match(r"(?:.{0,5}(?:住在|住|送货到|送到|寄到|寄往|寄|搬到|搬去|位于|地址是|地址|找不到|根据|从|去|家在|到|在|是|把))(?=[一-鿿]{2,})", raw)
                if lead:
                    start += lead.end()
                    left, raw = v[max(0, start - 6) : start], raw[lead.end() :]
            street = re.search(r"([一-鿿]*?)(?:大街|大道|胡同|路|街|道|巷|弄)", raw)
            bad = int(bool(re.search(r"(回|线|配|水|电|油|气|管|通|铁|知|轨|网|电)(?:路|道)", raw)))
            f = [english, int(bool(_ADDRESS_CUE.search(left))), min(len(street.group(1)) if street else 0, 12), int("市" in raw), int("区" in raw), int(bool(re.search("栋|单元|室|楼|幢|Apt|Flat", raw))), min(len(raw), 40) // 2, _edge(left[-1:]), _edge(v[m.end() : m.end() + 1]), bad, int("号" in raw)]
            yield Span("address", start, m.end(), f)


def _before(v: str, start: int) -> int:
    return _stands_before(v[max(0, start - 10) : start])


@lru_cache(maxsize=1 << 16)
def _stands_before(left: str) -> int:
    shown = left.rstrip(" :,。!?;/、(\"'“”—-[")
    low = shown.lower()
    if low.endswith(_NAME_LABEL):
        return 1
    if left and left == shown and low.endswith(_NAME_VERB):
        return 2
    if left == shown and low.endswith(_TRADE):
        return 3
    if not left:
        return 4
    if left[-1] in "—-/:|":
        return 5
    if left != shown:
        return 6
    return {3: 8, 4: 9}.get(_edge(left[-1]), 7)


def _after(v: str, end: int) -> int:
    right = v[end : end + 4]
    return _stands_after(right if not right[:1].isspace() else " " + v[end:].lstrip()[:1])


@lru_cache(maxsize=1 << 16)
def _stands_after(right: str) -> int:
    """By up to four characters, or a blank and the first character that isn't one."""
    if not right:
        return 1
    if right.startswith(_TITLE):
        return 8
    if right[0] in "(（/":
        return 2
    if right[0] == " ":
        rest = right[1:]
        return 3 if rest.isdigit() or rest in ("电", "手", "地") or _edge(rest) == 4 else 4
    if right[0].isdigit():
        return 3
    if not right[0].isalnum():
        return 5
    if right.startswith(_NAME_AFTER):
        return 6
    return 7


def _names(v: str) -> Iterator[Span]:
    n = len(v)
    for m in _FAMILY.finditer(v):
        s, first = m.start(), len(m.group(1))
        gap = 1 if v[s + first : s + first + 1] in (" ", "·") else 0
        at = s + first + gap
        if not _han(v[at : at + 1]):
            continue
        before = _before(v, s)
        kept = None
        later = _after(v, at + 1)
        for given in (1, 2):
            e = at + given
            if e > n or not _han(v[e - 1]):
                break
            after, longer = later, 0
            if e < n and _han(v[e]):
                longer = later = _after(v, e + 1)
            if before in (7, 8, 9) and after == 7:
                continue
            if kept is None:
                kept = [_RANK[v[s]] if first == 1 else 12, int(v[s - 1] in NOT_GIVEN) if s else 2, _before(v, s - 1) if s and v[s - 1] in _SURNAME else 0]
            odd = (v[at] in NOT_GIVEN) + (given == 2 and v[at + 1] in NOT_GIVEN)
            next_odd = int(v[e] in NOT_GIVEN) if e < n else 2
            yield Span("name", s, e, [given, first, gap, before, after, longer, odd, next_odd, *kept])
    for m in _LABELLED.finditer(v):  # family names that aren't listed, where a label says that a name follows
        s = m.end()
        for size in (2, 3):
            e, name = s + size, v[s : s + size]
            if e > n or name[0] in _SURNAME or not all(map(_han, name)) or any(c in NOT_GIVEN for c in name):
                break
            after = _after(v, e)
            if after != 7:
                longer = _after(v, e + 1) if e < n and _han(v[e]) else 0
                yield Span("name", s, e, [size - 1, 4, 0, 1, after, longer, 0, int(v[e] in NOT_GIVEN) if e < n else 2, 14, 0, 0])
    for pattern, case in ((_NAME_EN, 3), (_NAME_ANY_CASE, 5)):
        for m in pattern.finditer(v):
            s, e = m.span(1)
            name = v[s:e]
            words = name.replace("·", " ").split()
            if case == 5 and (all(w.istitle() for w in words) or not _NAME_END.match(v, e)):
                continue
            known = sum(w.lower() in _NOT_NAME_EN for w in words)
            following = _LATIN_WORD.match(v, e).group(1) or ""
            street = int(following.lower() in _NOT_NAME_EN and following[:1].isupper())
            number = int(bool(_HOUSE_BEFORE.search(v[max(0, s - 6) : s])))
            code = int(bool(_CODE_AFTER.match(v, e)))
            f = [3 + known, case + int(case == 5 and name.islower()), street, _before(v, s), _after(v, e), number, code, 3, 13, 0, 0]
            yield Span("name", s, e, f)


def candidates(view: str) -> list[Span]:
    out: list[Span] = []
    digit = _ANY_DIGIT.search(view)
    if digit and _TWO_DIGITS.search(view):
        out += _numbers(view)
    if digit or "号" in view:
        out += _addresses(view)
    if "@" in view or "at" in view.lower() or "艾特" in view:
        out += _emails(view)
    out += _names(view)
    return out


# ---- texts to learn from -------------------------------------------------------------------------------------------------

_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰涛明超秀霞平刚桂英华玉兰红梅建国志文斌宇浩然子轩梓涵欣怡诗雨佳琪思远嘉俊峰鹏飞雪琳婷婧瑶颖晨曦岚若熙舒雅凯瑞博翰哲睿铭泽宁安琦璐璇蕾薇菲莹妍彤悦馨淇沐阳煜祺珂珊琬昀彧湉澄楹榕棣荻菡霏"
_EN_FIRST = "Ada Basil Clara Dorian Edith Felix Greta Hugo Irma Jonas Karin Leo Mina Nils Olga Piers Rosa Simon Tessa Ulric Vera Walter Yasmin Zeno Marlo Corin Denna".split()
_EN_LAST = "Ashdown Birchall Coldwell Draycott Elmhirst Fenwick Garside Holbrook Ingleby Kettle Lockwood Marsden Norwood Oakley Pembury Quarles Ridgeway Stanhope Thornbury Underhill Wexford Yardley Whitlow Mossfield Sandrow Harrowgate".split()
_ROLES = "项目经理 水电师傅 木工师傅 监理 设计助理 门窗厂 橱柜厂家 物业管家 送货司机 瓦工班组 验房师 采购员 预算员 材料商 邻居 安装队 质检员 售后专员 油工班长 杂工".split()
_THINGS = "吊柜 地漏 瓷砖 石膏线 踢脚线 窗帘盒 暖气片 乳胶漆 木地板 配电箱 花洒 橱柜 马桶 灯带 岩板 铝扣板 空调孔 金属网 高柜 石材 白乳胶 方管 管线 水槽 温控器 门套 成品门".split()
_FAULTS = "渗水 松动 开裂 空鼓 起皮 高低不平 严重变形 色差 关不严 温度上不去 堵塞 翘边 返潮".split()
_PAPERS = "保修卡 付款凭证 合同附件 施工日志 材料清单 验收单 对账表 送货单 色卡 检测报告 变更单".split()
_WHEN = "验收前两日 开工当天 周末 雨后第二天 付尾款前 供暖期 明天 下周三 安装当周 量房之后".split()
_ACTS = "重新找平 现场签字 打磨修补 更换管件 封堵缝隙 满粘不留空 加装止回阀 做倒角 和楼下确认 金属收边 高温烘烤 通电测试 安装支架 成品保护 方便上门".split()
_STREET_A = "桂香 清溪 北辰 梧桐 长宁 凤凰 东湖 南岭 和平 文昌 胜利 柳荫 石桥 金谷 青松 望江 白塔".split()
_EN_STREET = "Maple Cedar Willow Orchard Mill Station Church Harbour Chestnut Rowan Linwood Elder".split()


class _Maker:
    """Makes texts with marked items; ``{kind}`` of a template is replaced by an item of the kind."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def wide(self, s: str) -> str:
        return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in s)

    def spoken(self, s: str) -> str:
        return "".join("零一二三四五六七八九"[int(c)] if c.isdigit() else c for c in s)

    def item(self, kind: str) -> str:
        r = self.r
        if kind == "name":
            if r.random() < 0.12:
                name = f"{r.choice(_EN_FIRST)} {r.choice(_EN_LAST)}"
                return r.choice([name] * 6 + [name.upper(), name.lower()])
            if r.random() < 0.05:  # a family name that isn't listed
                while (family := chr(r.randrange(0x4E00, 0x9FA6))) in _SURNAME or family in NOT_GIVEN:
                    pass
                return family + "".join(r.choice(_GIVEN) for _ in range(r.choice((1, 2, 2))))
            family = r.choice(COMPOUND) if r.random() < 0.03 else r.choice(SURNAMES[: 60 if r.random() < 0.4 else 230])
            return family + r.choice(["", "", "", "", "", "", "", " "]) + "".join(r.choice(_GIVEN) for _ in range(r.choice((1, 2, 2))))
        if kind == "phone":
            x = r.random()
            if x < 0.65:
                d = r.choice("1") + r.choice("3456789") + self.digits(9)
                d = r.choice([d, d, d, f"{d[:3]}-{d[3:7]}-{d[7:]}", f"{d[:3]} {d[3:7]} {d[7:]}", f"{d[:3]}.{d[3:7]}.{d[7:]}", f"+86 {d}", f"+86{d}", f"0086-{d}", f"86-{d}", f"(+86){d}", self.wide(d), self.spoken(d)])
                return d
            area = r.choice(["010", "021", "024", "0411", "0431", "0755", "028"])
            return area + r.choice(["-", " ", "", "—"]) + self.digits(8)
        if kind == "id_number":
            d = r.choice(["110105", "310104", "440305", "210203", "510107", "220104", "330106"]) + str(r.randint(1940, 2012)) + f"{r.randint(1, 12):02d}{r.randint(1, 28):02d}" + self.digits(3)
            d += "10X98765432"[sum(int(c) * pow(2, 17 - k, 11) for k, c in enumerate(d)) % 11] if r.random() < 0.5 else r.choice("0123456789X")
            return r.choice([d, d, d, f"{d[:6]} {d[6:14]} {d[14:]}", f"{d[:6]}-{d[6:14]}-{d[14:]}", self.wide(d), d.lower()])
        if kind == "email":
            words = [r.choice("li wen hao jia xue min tong yan bo fei rui han dan ning kuo".split()) for _ in range(r.choice((1, 2, 2)))]
            local = r.choice(["", ".", "_", "-"]).join(words) + r.choice(["", self.digits(3), "+shop", self.digits(2)])
            dot = r.choice([".", ".", ".", ".", "(dot)", "[dot]", " dot ", "。", "．"])
            at = r.choice(["@", "@", "@", "@", "＠", " @ ", "[at]", " at ", "(at)", " [at] "])
            e = local + at + r.choice("mailbox sample firma company inbox school".split()) + dot + r.choice("test example invalid com net org cn".split())
            return e.upper() if r.random() < 0.06 else e
        if r.random() < 0.12:
            s = f"{r.randint(1, 300)} {r.choice(_EN_STREET)} {r.choice(['Street', 'Lane', 'Road', 'Avenue'])}"
            return r.choice([s, f"{s}, Apt {r.randint(1, 40)}", f"Flat {r.randint(1, 40)}, {s}"])
        no = str(r.randint(1, 300))
        no = r.choice([no, no, no, self.wide(no), self.spoken(no)])
        s = r.choice(["", "", "苏州市", "某市", "青岛市"]) + r.choice(["", "", "高新区", "南湖区"]) + r.choice(_STREET_A) + r.choice(["", "南", "北"]) + r.choice(["路", "街", "大道", "巷", "胡同"]) + no + "号"
        return s + r.choice(["", "", f"{r.randint(1, 30)}栋{r.randint(1, 4)}单元{r.randint(101, 3000)}室", f"{r.randint(1, 30)}-{r.randint(1, 4)}-{r.randint(101, 3000)}", f"{r.choice(['云岭居', '锦绣园', '兰亭苑'])}{r.randint(1, 30)}号楼{r.randint(101, 3000)}"])

    def word(self, key: str) -> str:
        r = self.r
        return {
            "role": lambda: r.choice(_ROLES), "thing": lambda: r.choice(_THINGS), "fault": lambda: r.choice(_FAULTS), "paper": lambda: r.choice(_PAPERS), "when": lambda: r.choice(_WHEN), "act": lambda: r.choice(_ACTS),
            "order": lambda: r.choice("1456789") + self.digits(r.choice((9, 12, 13, 15, 17, 17, 17))), "money": lambda: str(r.randint(100, 9999)), "title": lambda: r.choice(SURNAMES[:80]) + r.choice(["工", "总", "师傅", "监理", "经理", "老师", "先生", "女士"]),
            "estate": lambda: r.choice(["云岭", "锦绣", "兰亭"]) + r.choice(["居", "园", "里"]), "size": lambda: f"{r.randint(100, 999)}*{r.randint(100, 999)}", "day": lambda: f"2026-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", "real": lambda: f"{r.randint(1, 9999)}.{self.digits(2)}",
            "brand": lambda: r.choice(["Lorvex", "Saniko", "Veltra", "Dombry", "Krafto"]) + " " + r.choice("ABKMRTX") + r.choice("CDLPSZ") + self.digits(4), "street": lambda: r.choice(_STREET_A) + r.choice(["路", "街", "巷"]), "no": lambda: str(r.randint(1, 40)),
        }[key]()

    def text(self) -> tuple[str, list[tuple[str, int, int]]]:
        out, marks = "", []
        for piece in re.split(r"(\{\w+\})", self.r.choice(["", "", "", "您好，", "  "]) + self.r.choice(TEMPLATES)):
            if piece[:1] != "{":
                out += piece
                continue
            key = piece[1:-1]
            s = self.item(key) if key in KINDS else self.word(key)
            if key in KINDS:
                marks.append((key, len(out), len(out) + len(s)))
            out += s
        return out + self.r.choice(["", "", "", "。", "\n"]), marks


# Texts as people and staff write them, with and without personal items; for training only.
TEMPLATES = """我是{name}，{thing}{fault}，电话{phone}
本人{name}，住{address}，{thing}{fault}了
业主{name}反映{thing}{fault}，手机{phone}
业主姓名：{name} 身份证号：{id_number}
户主{name}（{id_number}）请{name}代签
收货人{name} {phone} {address}
联系人：{name} 手机：{phone} 地址：{address}
{name} {id_number} {phone}
{name} {phone}
{id_number}
{address}
{email}
{phone}
{name}/{id_number}/{address}
登记：{name}，{phone}，{thing}{fault}
请{name}{when}到现场{act}
请通知{name}带{paper}来
请{name}带身份证（{id_number}）来办手续
找{name}签字还是打{phone}
{role}{name}的电话是{phone}
请直接联系{role}{name}，手机 {phone}
已通知{role}{name}，{when}联系您
合同写的是{name}，付款人是{name}，可以吗
房本上是{name}，和{paper}上的{name}对不上
{paper}请转给{name}，抄送{email}
{paper}发{email}，谢谢
{paper}已发到{email}，请查收。{role}说要{act}
把{paper}同时发给{email}和{email}
发票开给{name}，寄到{address}，问题发{email}
发票抬头{name}，电子版发{email}
上次来的{name}说要{act}
帮我查一下{name}那户的{paper}
查下{name}那户的{thing}，{when}验收
{name}那户{thing}{fault}，帮忙看下
Write to {email} or to {email} please
Ask {name} at {email} about the worktop
{name}家的{thing}{fault}
这户是{name}，不是{name}
{thing}{fault}，快来！——{name} {phone}
{thing}{fault}，请回{phone}
微信同号{phone}，请把{paper}发我
{phone}是{role}的号码吗，打不通
{role}电话{phone}和{phone}哪个对
{role}{when}到{address}，请保持{phone}畅通
您的地址{address}已记下，{role}会上门
从{address}搬到{address}，{thing}怎么算
找不到{address}，{role}说在{estate}
家住{address}，{thing}{fault}
送到{address}，收件人{name}
按{address}的{paper}，建议{act}
{address}{when}方便量房吗
已为{name}登记，{when}回电{phone}
委托{name}验收{thing}，要带什么
证件号 {id_number} 写错了，{paper}能改吗
My name is {name}, write to me at {email} about the tiles
Please call {name} on {phone} before the visit
I am {name}, I live at {address}
{paper}丢了怎么补
{thing}要不要{act}
{thing}{fault}是什么原因
{title}说要{act}，对吗
{title}和{title}意见不一样，听谁的
建议由{title}复核{thing}，读数 {real}
{role}说{thing}{fault}，要{act}吗
请{when}联系{role}
请联系{role}确认{thing}
订单号{order}到哪了
订单{order}已出库
批号{order}的{thing}能用吗
合同编号 HT-2026-{no}77-{no}3 是否有效
快递单号{order}查一下
水表读数 {real}，{thing}是不是{fault}
工期 {day} 到 {day} 够不够
{size} 的{thing}铺厨房
{thing}费 {money} 元贵不贵
{thing}费约 {money}-{money} 元，以{paper}为准
{estate}的房子{thing}{fault}正常吗
{street}那边人工费一般多少
邮箱收不到{paper}怎么办
地址写错了能改{paper}吗
手机上怎么看{paper}
热线是400开头的那个吗
身份证复印件要几份，{when}交吗
@客服 {thing}{fault}
{brand} 这款{thing}怎么样
{brand}的{thing}坏了，{role}说{act}
{thing}{fault}多由{thing}{fault}引起，建议{act}
先{act}，再{act}
可参考规范 QZ {no}12-2025 第 {no}.4.16 条
插座回路配 {no} 路，客厅单独一路
{thing}厚度 {no} mm，{no} 小时后{act}
{when}能{act}吗
GZ-SY-0{no}11 这条说的{act}靠谱吗
{thing}和{thing}哪个好
现代风客厅用什么{thing}
Is the {brand} good for the kitchen
设计费和管理费分开列，{paper}第 {no} 条写清责任
{role}一直不接，打我{phone}
安装方案是谁定的，{thing}高低不平
石材和金属收边哪个贵
方便的话{when}来看{thing}
成品柜和定制柜哪个划算
{when}用方管支撑再{act}
隐蔽工程记录和节点照片都要留
先铲除旧层，再用石膏找平
阳台外墙保温施工，{when}能完工吗
{thing}安装时没有成品保护
建议改用不锈钢石英石台面
卫生间常温水管和暗管怎么走
厨房烟道止逆阀高度不够
{thing}{fault}，建议做木方加固
把{paper}和隐蔽工程单据一起留存
设备间通风、卧室温控都有问题
验收时发现全屋窗户严重漏风
{role}要求先湿润基层再施工
样板间毛坯房交付标准是什么
项目部说钱已经付了，{thing}什么时候装
下单之前能看成品吗，别墅阳光房怎么做
{thing}缝宽不均，时间太长了
地暖管平铺还是回形，管卡太少
雷雨天能施工吗，路面温度多少
{phone}这个号是谁的，{when}打不通
{name} {id_number} {phone} {address}
{thing}{fault}，急。——{name} {phone}
{thing}{fault}，急。——{phone}
My name is {name}, email {email} or call {phone} about the boiler
根据{address}的隐蔽工程记录，建议{act}
{address}的节点照片已收到
身份证{id_number}{phone}
身份证号{id_number}{phone}，{name}
电话{phone}{phone}
电话{phone} {phone}
电话{phone} {phone}，{thing}{fault}
{phone} {phone}
手机{phone}，座机{phone}
请打{phone}或{phone}，{when}都在
{phone}/{phone}
联系{phone}、{phone}
{name} {phone} {phone}
物流码{order}{order}查不到
流水{order}{order}
条码 {order}{order} 扫不出
{order} {order}
订单{order} {order}
姓名：{name}，{thing}{fault}
联系人{name}，{thing}{fault}
业主{name}，{address}
经办人：{name}
申请人 {name} {phone}
业主为{name}，{when}验收
name: {name}, tiles arrived broken
Hi, this is {name}, the {brand} leaks
i am {name}, please call {phone}
my name is {name} and the boiler is loud
业主反映{thing}{fault}
业主要求{act}
业主投诉{thing}{fault}，{role}没来
业主同意，{act}
业主认可，可以签字
业主自购，{thing}自己运
业主嫌贵，不要{thing}了
业主着急，{when}能来吗
业主不满意{thing}
业主群里有人说{thing}{fault}
业主委托{role}验收
业主本人，{when}到场
联系人写错了，能改吗
联系人空缺，怎么填
收件人拒收，{thing}退回
收件人地址改一下
姓名保密，别登记
姓名拼音写错，{paper}要重开吗
付款人账户不对
申请人签字，{role}盖章
户主变更，{paper}要换吗
I am happy with the {brand}
this is urgent, {thing}{fault}
ask for refund, please
i am waiting, call me""".split("\n")


def _labelled(examples: int, seed: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    maker = _Maker(seed)
    rows: dict[str, tuple[list, list]] = {k: ([], []) for k in KINDS}
    for _ in range(examples):
        text, marks = maker.text()
        view, at = _view(text)
        true = {(k, s, e) for k, s, e in marks}
        for c in candidates(view):
            s, e = at[c.start], at[c.end - 1] + 1
            # a number or address counts if it covers nearly the whole item; a name must be exact
            hit = (c.kind, s, e) in true or c.kind != "name" and any(k == c.kind and min(e, f) - max(s, b) >= 0.8 * max(e - s, f - b) for k, b, f in true)
            rows[c.kind][0].append(c.features)
            rows[c.kind][1].append(hit)
    return {k: (np.array(x, np.int64).reshape(len(x), -1), np.array(y, float)) for k, (x, y) in rows.items()}


@lru_cache(maxsize=2)
def models(examples: int = 16_000, seed: int = 5) -> dict[str, tuple[Boosted, float]]:
    """Trees and threshold of each kind: the threshold of the best F1 on a quarter as many texts of another seed."""
    out = {}
    held = _labelled(examples // 4, seed + 1)
    for kind, (x, y) in _labelled(examples, seed).items():
        model = Boosted(x, y)
        hx, hy = held[kind]
        p = model.probability(hx)
        grid = np.arange(0.1, 0.91, 0.05)
        f1 = np.array([2 * ((p >= g) & (hy > 0)).sum() / max(1, (p >= g).sum() + hy.sum()) for g in grid])
        best = grid[f1 >= f1.max() - 1e-9]
        out[kind] = (model, float(best[np.abs(best - 0.5).argmin()]))
    return out


def find(texts: list[str | None], fitted: dict[str, tuple[Boosted, float]]) -> list[list[Span]]:
    """The spans to redact in each text, in order, by places in the text itself."""
    spans: dict[str, list[tuple[int, Span]]] = {k: [] for k in KINDS}
    maps: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        if not t:
            continue
        view, at = _view(t)
        for c in candidates(view):
            spans[c.kind].append((k, c))
            maps[k] = at
    passed: list[list[Span]] = [[] for _ in texts]
    for kind, rows in spans.items():
        if not rows:
            continue
        model, threshold = fitted[kind]
        for (k, c), p in zip(rows, model.probability(np.array([c.features for _, c in rows], np.int64)), strict=True):
            if p >= threshold:
                c.p = float(p)
                passed[k].append(c)
    for k, found in enumerate(passed):
        chosen: list[Span] = []
        for c in sorted(found, key=lambda c: (c.kind == "name", -c.p, c.start - c.end, c.start)):
            if all(c.end <= o.start or c.start >= o.end for o in chosen):
                chosen.append(c)
        for c in chosen:
            c.start, c.end = maps[k][c.start], maps[k][c.end - 1] + 1
        passed[k] = sorted(chosen, key=lambda c: c.start)
    return passed


def redact(text: str | None, spans: list[Span]) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, key_col: str = "log_id", fields: tuple[str, ...] = ("user_query", "response_snippet"), examples: int = 16_000) -> DataFrame:
    """``key_col``, each field with typed placeholders (``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]``, ``[NAME]``), and ``<field>_kinds``, the kinds found in it.

    All rows are kept, repeated ones too. Null stays null, empty text empty, and text without findings unchanged to the
    character. The trees are fitted once, on the driver, and sent with the task.
    """
    fitted = models(examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, list[str]]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                arrays, names = [b.column(0)], [key_col]
                columns = [b.column(k + 1).to_pylist() for k in range(len(fields))]
                if len(known) > KNOWN:
                    known.clear()
                new = list({t for texts in columns for t in texts if t and t not in known})
                for t, spans in zip(new, find(new, fitted), strict=True):
                    known[t] = redact(t, spans), sorted({s.kind for s in spans})
                for f, texts in zip(fields, columns, strict=True):
                    arrays.append(pa.array([known[t][0] if t else t for t in texts], pa.string()))
                    arrays.append(pa.array([known[t][1] if t else None if t is None else [] for t in texts], pa.list_(pa.string())))
                    names += [f, f"{f}_kinds"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = df.schema[key_col].dataType.simpleString()
    schema = f"`{key_col}` {kind}, " + ", ".join(f"`{f}` string, `{f}_kinds` array<string>" for f in fields)
    return df.select(F.col(f"`{key_col}`"), *(F.col(f"`{f}`").cast("string") for f in fields)).mapInArrow(run, schema)


def kinds_found(df: DataFrame, key_col: str = "log_id", fields: tuple[str, ...] = ("user_query", "response_snippet"), examples: int = 16_000) -> DataFrame:
    """``key_col, field, kind``: a row for each kind that a text of the key holds. Rows without key have none."""
    r = redacted(df, key_col, fields, examples).where(F.col(f"`{key_col}`").isNotNull())

    def named(field: str):
        kinds = F.coalesce(F.col(f"`{field}_kinds`"), F.array().cast("array<string>"))
        return F.transform(kinds, lambda k: F.struct(F.lit(field).alias("field"), k.alias("kind")))

    pairs = F.explode(F.concat(*map(named, fields)))
    return r.select(F.col(f"`{key_col}`"), pairs.alias("x")).select(F.col(f"`{key_col}`"), "x.field", "x.kind").distinct()
