"""Names: cleaning, templates, episode and title rules, clip names, answers of models."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that file names must not have.
INVALID = '<>:"/\\|?*'
#: Placeholders that every name format may use.
SYSTEM_PLACEHOLDERS = ("起始帧", "视频解析名", "扩展名")
#: Numbers that are resolutions, not episodes.
RESOLUTIONS = (480, 720, 1080, 2160, 4320)
#: Tags of clip names by category.
TAGS = {
    "shot_scale": (
        "远景", "全景", "中景", "近景", "特写", "大特写", "极远景", "中近景", "中全景", "过肩镜头",
    ),
    "emotion": (
        "孤独", "紧张", "恐惧", "悲伤", "喜悦", "愤怒", "平静", "焦虑", "绝望", "希望", "忧郁", "兴奋", "惊讶", "厌恶", "温馨", "压抑", "轻松", "沉重", "神秘", "浪漫", "伤感", "欢快", "阴郁",
        "明朗",
    ),
    "subject": (
        "人物", "人群", "女孩", "男孩", "男人", "女人", "老人", "孩子", "动物", "建筑", "车辆", "物品", "风景", "天空", "大海", "山脉", "树木", "花草", "街道", "房间", "城市", "乡村",
    ),
    "action": (
        "站立", "行走", "奔跑", "静止", "坐着", "躺着", "跳跃", "飞行", "游泳", "驾驶", "交谈", "拥抱", "打斗", "舞蹈", "工作", "休息", "穿梭", "等待", "观望", "思考", "哭泣", "微笑", "转身",
        "离开",
    ),
    "background": (
        "室内", "室外", "白天", "夜晚", "黄昏", "黎明", "雨天", "晴天", "雪景", "雾气", "都市", "郊外", "海边", "山区", "森林", "沙漠", "办公室", "家庭", "学校", "医院", "餐厅", "商场", "公园",
        "车站",
    ),
    "camera_movement": (
        "推", "拉", "摇", "移", "跟", "升", "降", "甩", "晃", "固定", "手持", "航拍", "旋转", "环绕", "俯拍", "仰拍", "平移", "变焦", "聚焦", "虚焦",
    ),
}
TAG_ORDER = (*TAGS, "other")
#: Fields of a two-frame answer, the word before each and how many characters count.
ANSWER_FIELDS = {"shot_scale": ("景别", 6), "emotion": ("情绪", 4), "subject": ("主体", 2), "action": ("动作", 2), "background": ("背景", 2), "camera_movement": ("镜头", 6)}
NONE_TAG, UNKNOWN, SAME, DIFFERENT, YES = "无", "未知", "相同", "不同", "是"
SCORE_TAG = "分值"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named. Long chains of patterns go into it: written out,
    their generated code outgrows what a method may have, and the whole stage falls back to interpreting."""
    return F.transform(F.array(value), use)[0]


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def replace_invalid(s: Column) -> Column:
    return F.translate(s, INVALID, "_" * len(INVALID))


def sanitise(s: Column) -> Column:
    """Invalid characters become ``_``; white space at both ends goes."""
    return strip(replace_invalid(s))


def sanitise_result(s: Column) -> Column:
    """Invalid characters become ``_``; ``_`` at both ends goes."""
    return F.btrim(replace_invalid(s), F.lit("_"))


def sanitise_preset(s: Column) -> Column:
    """White space at the ends, invalid and control characters, dots and blanks at the end; 120 characters at most."""
    return F.left(F.rtrim(F.regexp_replace(strip(s), r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(". ")), F.lit(120))


def sanitise_folder(s: Column) -> Column:
    """A prompt as a folder's name: 80 characters, then ``_``, dots and blanks at both ends go; empty: export."""
    out = F.btrim(F.left(F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(80)), F.lit("_. "))
    return F.when(out == "", "export").otherwise(out)


def sanitise_word(s: Column) -> Column:
    """Letters and digits of any script, blanks, dots, ``_`` and ``-`` stay."""
    return strip(F.regexp_replace(s, r"[^\p{L}\p{N} ._-]", ""))


def stem(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def extension(path: Column, default: str = ".mp4") -> Column:
    found = F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)(\.[^.]*)$", 1)
    return F.when(found == "", default).otherwise(found)


def is_op_ed(name: Column) -> Column:
    """Whether ``_``-separated parts of a name mark an opening or ending."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return low.rlike(r"(?:^|_)nc(?:op|ed)(?:\d+|_\d+)?(?:_|$)") | low.rlike(r"(?:^|_)(?:op|ed)(?:\d+|_\d+)?(?:_|$)")


def placeholders(template: str) -> list[str]:
    return re.findall(r"\{([^}]+)\}", template)


def result_name(template: str, values: dict[str, Column]) -> Column:
    """A name by template: values that are null or not given are empty; separators that meet become one, those at the ends go."""
    parts = re.split(r"\{([^}]+)\}", template)
    name = F.concat(*[F.lit(p) if i % 2 == 0 else sanitise(F.coalesce(values[p].cast("string"), F.lit(""))) if p in values else F.lit("") for i, p in enumerate(parts)])
    for mark in sorted(set(re.findall(r"\}([^{]+)\{", template))):
        quoted = re.escape(mark)
        name = F.regexp_replace(name, f"(?:{quoted}){{2,}}", mark.replace("\\", "\\\\").replace("$", "\\$"))
        name = F.btrim(name, F.lit(mark))
    return name


def template_regex(template: str) -> str:
    """The template read backwards: each placeholder as a shortest match, up to the end."""
    parts = re.split(r"\{([^}]+)\}", template)
    return "^" + "".join(re.escape(p) if i % 2 == 0 else "(.+?)" for i, p in enumerate(parts)) + "$"


def label_key(name: Column, template: str, exclude: tuple[str, ...] = SYSTEM_PLACEHOLDERS[:2]) -> Column:
    """Labels of a name joined by ``_``; the whole name where the template does not fit."""
    pattern, fields = template_regex(template), placeholders(template)
    found = [F.regexp_extract(name, pattern, i + 1) for i, f in enumerate(fields) if f not in exclude]
    return F.when(name.rlike(pattern), F.concat_ws("_", *found)).otherwise(name)


def parsed_part(name: Column, template: str, part: str = SYSTEM_PLACEHOLDERS[1]) -> Column:
    """One placeholder's part of a name; empty where the template does not fit or has no such placeholder."""
    fields = placeholders(template)
    return F.regexp_extract(name, template_regex(template), fields.index(part) + 1) if part in fields else F.lit("")


def bad_placeholders(template: str, categories: list[str]) -> list[str]:
    return [p for p in placeholders(template) if p not in categories and p not in SYSTEM_PLACEHOLDERS]


#: The season, wherever it stands in a name.
SEASON = r"(?iU)(?:S|Season)[\s_\-]*(\d+)"
#: Openings and endings, in this order, and what each becomes. ``{n}`` is a group, ``:02`` a number of two
#: digits at least, ``:up`` capitals, ``:kind`` capitals by KINDS, ``:stamped`` the stamp where the group is empty.
THEME_RULES = (
    (r"(?iU)(?<![A-Za-z])S(\d+)((?:NC)?(?:OP|ED))(\d+[A-Za-z]*)", "S{1:02}{2:up}{3}"),
    (r"(?iU)(?<![A-Za-z])S(\d+)((?:NC)?(?:OP|ED))(?![A-Za-z0-9])", "S{1:02}{2:up}"),
    (r"(?iU)(?<![A-Za-z])(NC)?(OP|ED)(\d+[A-Za-z]*)", "{season}{1:up}{2:up}{3}"),
    (r"(?iU)(?<![A-Za-z])(NC)?(OP|ED)(?![A-Za-z0-9])", "{season}{1:up}{2:up}"),
    (r"(?iU)\bOpening\b", "{season}OP"),
    (r"(?iU)\bEnding\b", "{season}ED"),
)
#: All other forms, in this order.
EPISODE_RULES = (
    (r"(?iU)(?:E|EP|Episode)[\s_\-]*(\d+)", "{season}E{1:02}"),
    (r"(?:^|[\s\-])(\d+\.\d+)(?:$|[\s\-])", "{season}E{1}"),
    (r"[Ss](\d+)\s*\[(\d+)\]", "S{1:02}E{2:02}"),
    (r"[Ss](\d+)[\s_\-]+(\d+)", "S{1:02}E{2:02}"),
    (r"(?iU)\b(OVA|OAD|SP|Special)[\s_\-]*(\d*)\b", "{1:kind}{2}"),
    (r"(?iU)\b(Movie|Film)[\s_\-]*(\d*)\b", "Movie{2}"),
    (r"(?iU)\bMusic[\s_\-]*Video[\s_\-]*(\d*)\b", "MV{1:stamped}"),
    (r"(?iU)\b(PV|MV|Trailer|Preview|CM)(\d*)\b", "{1:kind}{stamp}"),
    (r"[\s\-_\[]+(\d{1,3})(?:[\s\-_\.\]\)]|$)", "E{1:02}"),
)
#: Forms whose episode (the last group) has to be under 500 and no resolution.
CHECKED = (r"[Ss](\d+)[\s_\-]+(\d+)", r"[\s\-_\[]+(\d{1,3})(?:[\s\-_\.\]\)]|$)")
#: Kinds that are written otherwise.
KINDS = {"SPECIAL": "SP", "TRAILER": "PV", "PREVIEW": "PV", "CM": "PV"}


def _two(digits: Column) -> Column:
    """A number with two digits at least, as text."""
    return F.regexp_replace(F.concat(F.lit("0"), digits), r"(?U)^0+(?=\d\d)", "")


def _by_rule(name: Column, stamp: Column, season: Column, pattern: str, form: str) -> Column:
    """What ``form`` makes of the first place of ``pattern``; null where there is none."""

    def part(field: str) -> Column:
        if field in ("season", "stamp"):
            return {"season": season, "stamp": stamp}[field]
        number, _, how = field.partition(":")
        group = F.regexp_extract(name, pattern, int(number))
        if how == "02":
            return _two(group)
        if how == "stamped":
            return F.when(group == "", stamp).otherwise(group)
        if how == "kind":
            kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
            return F.coalesce(F.try_element_at(kinds, F.upper(group)), F.upper(group))
        return F.upper(group) if how == "up" else group

    fits = name.rlike(pattern)
    if pattern in CHECKED:
        number = F.regexp_extract(name, pattern, re.compile(pattern).groups).try_cast("long")
        fits &= (number < 500) & ~number.isin(*RESOLUTIONS)
    parts = re.split(r"\{([^}]+)\}", form)
    return F.when(fits, F.concat(*[part(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)]))


def episode(name: Column, stamp: Column, guessed: Column | None = None) -> Column:
    """Episode part of a video's name (without extension); ``stamp`` is the time that nameless previews take.

    guessed: what a parser of release names found, struct(title string, season int, episode string), from a parser that the
    user runs. Openings and endings go before its episode, all other rules after it."""

    def by_rules(n: Column) -> Column:
        # "S" and two digits, or nothing where the name has no season
        season = F.regexp_replace(F.concat(F.lit("S0"), F.regexp_extract(n, SEASON, 1)), r"(?U)(?<=^S)0+(?=\d\d)|^S0$", "")
        themes = [_by_rule(n, stamp, season, *rule) for rule in THEME_RULES]
        others = [_by_rule(n, stamp, season, *rule) for rule in EPISODE_RULES]
        return F.coalesce(*themes, *told, *others, F.concat(F.lit("PV"), stamp))

    told = []
    if guessed is not None:
        number = guessed["episode"]
        told = [
            F.concat(F.lit("S"), _two(guessed["season"].cast("string")), F.lit("E"), _two(F.regexp_replace(number, r"\..*$", ""))),
            F.concat(F.lit("E"), F.when(number.contains("."), number).otherwise(_two(number))),
        ]
    return bound(name, by_rules)


#: What titles lose, in this order.
TITLE_REMOVALS = (
    r"\[.*?\]",
    r"[\s\-_]*\bS\d+E\d+(?:v\d+)?\b",
    r"[\s\-_]*\bS[\s_\-]*\d+\b",
    r"[\s\-_]*\bE[\s_\-]*\d+\b",
    r"[\s\-_]*\bEP[\s_\-]*\d+\b",
    r"[\s\-_]*\bSeason[\s_\-]*\d+\b",
    r"[\s\-_]*\bEpisode[\s_\-]*\d+\b",
    r"[\s\-_]*\b(?:NC)?(?:OP|ED)\d*\b",
    r"[\s\-_]*\bOpening\b[\s\-_]*\bTheme\b",
    r"[\s\-_]*\bEnding\b[\s\-_]*\bTheme\b",
    r"[\s\-_]*\bOpening\b",
    r"[\s\-_]*\bEnding\b",
    r"[\s\-_]*\bSpecial[\s_\-]*\d*\b",
    r"[\s\-_]*\b(?:OVA|OAD|SP)[\s_\-]*\d*\b",
    r"[\s\-_]*\bFilm[\s_\-]*\d*\b",
    r"[\s\-_]*\b(?:PV|MV|Trailer|Preview|CM)\d*\b",
    r"[\s\-_]+\d{1,3}(?=[\s\-_\.]|$)",
    r"\b(?:x26[45]|HEVC|H\.?264|AVC|10bit|Hi10P)\b",
    r"\b(?:FLAC|AAC|AC3|DTS|MP3|Opus)\b",
    r"\b(?:1080p|720p|480p|2160p|4K|BD|BluRay|WEB-DL|HDR)\b",
    r"\s*[\(\[]\d{4}[\)\]]",
)


def title(name: Column, guessed: Column | None = None) -> Column:
    """A video's title from its name (without extension), or from the title of ``guessed`` where that is not empty; what is
    cleaned stays as it is where nothing is left."""
    if guessed is not None:
        told = guessed["title"]
        name = F.when(told != "", told).otherwise(name)

    def cleaned(n: Column) -> Column:
        for pattern in TITLE_REMOVALS:
            n = strip(F.regexp_replace(n, "(?iU)" + pattern, ""))
        return strip(F.regexp_replace(n, r"(?U)[\s\-_]+", " "))

    return bound(name, lambda n: bound(cleaned(n), lambda out: F.when(out == "", n).otherwise(out)))


def video_name(path: Column, stamp: Column, given: Column | None = None, guessed: Column | None = None) -> Column:
    """title_episode of a path; ``given`` is used as the title where it is not empty."""

    def named(name: Column) -> Column:
        own = title(name, guessed)
        return F.concat_ws("_", own if given is None else F.when(given != "", given).otherwise(own), episode(name, stamp, guessed))

    return bound(stem(path), named)


def index_name(source: str, model: str, dim: int | None = None) -> str:
    """The name of an index: source and model, and the dimension where vectors are cut. Names are not nested twice."""
    suffix = f"_{model}" + (f"_d{dim}" if dim else "")
    return source if source.endswith(suffix) else source + suffix


# fixed values: modes that an index name may end with
INDEX_MODES = ("Single", "Triplet", "TripletAvg", "SceneNative3f", "SceneNative", "SceneDetect", "Video")


def index_model(name: Column, models: Sequence[str] = ()) -> Column:
    """The model that an index name says. Extension, mode and dimension go from its end; then the longest of the known
    ``models`` counts that is the whole rest or follows a ``_`` at its end, and where none does, all after the first
    ``_``. Empty without either."""
    bare = F.regexp_replace(name, r"\.[A-Za-z]+$", "")
    for end in ("_(" + "|".join(INDEX_MODES) + ")$", r"_d\d+$"):
        bare = F.regexp_replace(bare, end, "")
    rest = F.regexp_extract(bare, "(?s)^[^_]*_(.*)$", 1)
    if not models:
        return rest
    known = F.array(*map(F.lit, sorted(models, key=lambda m: (-len(m), m))))
    matches = F.filter(known, lambda m: (bare == m) | F.endswith(bare, F.concat(F.lit("_"), m)))
    return F.coalesce(F.try_element_at(matches, F.lit(1)), rest)


def index_dim(name: Column) -> Column:
    found = F.regexp_extract(name, r"_d(\d+)(?:_|\.|$)", 1)
    return F.when(found != "", found.cast("int"))


def tag_category(tag: Column) -> Column:
    """Category of a clip tag; the first that has it, or other."""
    out = F.lit("other")
    for category in reversed(list(TAGS)):
        out = F.when(tag.isin(*TAGS[category]), category).otherwise(out)
    return out


def clip_parts(name: Column) -> Column:
    """struct(series_name, episode, start_frame, tags, score) of a clip's name (without extension).

    Parts are separated by ``_``. A last part of one digit from 1 after a number only tells equal names apart and goes.
    Then start frame, episode and series are last; the rest is tags or a score. Names of fewer than three parts are tags."""
    parts = F.split(name, "_")
    n = F.size(parts)
    suffix = (n >= 3) & F.element_at(parts, -1).rlike("^[1-9]$") & F.when(n >= 2, F.element_at(parts, -2).rlike(r"^\d+$")).otherwise(False)
    kept = F.when(suffix, F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))).otherwise(parts)
    m = F.size(kept)
    short = n < 3
    head = F.when(short, parts).otherwise(F.filter(F.slice(kept, 1, F.greatest(m - 3, F.lit(0))), lambda p: p != ""))
    score_of = r"^(?:" + SCORE_TAG + r"|(?i:score))(\d+)$"

    def is_score(p: Column) -> Column:
        return p.rlike(score_of) | p.rlike(r"^\d{1,2}$")

    scores = F.filter(head, is_score)
    value = F.regexp_extract(F.try_element_at(scores, F.lit(-1)), r"(\d+)$", 1).cast("int")

    def part(at: int) -> Column:
        return F.when(short, "").otherwise(F.coalesce(F.try_element_at(kept, F.lit(at)), F.lit("")))

    return F.struct(
        part(-3).alias("series_name"),
        part(-2).alias("episode"),
        part(-1).alias("start_frame"),
        F.when(short, head).otherwise(F.filter(head, lambda p: ~is_score(p))).alias("tags"),
        F.when(short, F.lit(None).cast("int")).otherwise(value).alias("score"),
    )


def clip_order(name: Column) -> Column:
    """The start frame that clips are sorted by: the last number of the name, without a telling-apart digit; else 0."""
    parts = F.split(name, "_")
    numbers = F.filter(parts, lambda p: p.rlike(r"^\d+$"))
    last_two = F.try_element_at(parts, F.lit(-2))
    suffix = F.element_at(parts, -1).rlike("^[1-9]$") & F.coalesce(last_two.rlike(r"^\d+$"), F.lit(False))
    return F.coalesce(F.when(suffix, last_two.cast("long")), F.try_element_at(numbers, F.lit(-1)).cast("long"), F.lit(0).cast("long"))


def answer_fields(text: Column) -> dict[str, Column]:
    """Fields of an answer in lines of ``word: value``; brackets go, values are cut to a length."""
    out = {}
    for key, (word, most) in ANSWER_FIELDS.items():
        value = strip(F.regexp_extract(text, word + r"[：:]\s*([^\n]+)", 1))
        out[key] = F.left(F.regexp_replace(value, r"[【】\[\]（）()]", ""), F.lit(most))
    return out


def answer_name(text: Column) -> Column:
    """Fields of an answer joined by ``_``, without empty ones; unknown where none is left."""
    values = [F.btrim(v, F.lit("_")) for v in answer_fields(text).values()]
    joined = F.array_join(F.filter(F.array(*values), lambda v: (v != "") & (v != NONE_TAG)), "_")
    return F.when(joined == "", UNKNOWN).otherwise(joined)


def answer_score(text: Column) -> Column:
    """First number of an answer, between 1 and 10; 4 where there is none."""
    digits = F.regexp_extract(text, r"(\d+)", 1)
    n = F.when(F.length(digits) > 9, F.lit(10)).otherwise(digits.try_cast("int"))
    return F.when(n.isNull(), 4).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), n)))


def answer_same(text: Column) -> Column:
    bare = F.regexp_replace(strip(text), " ", "")
    return bare.contains(SAME) & ~bare.contains(DIFFERENT)


def json_part(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty where there is none."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def verdicts(text: Column, categories: list[str], exact: bool = True, strict: bool = False) -> Column:
    """map(category -> boolean) of a JSON answer. exact: the value is yes; otherwise it only has to hold a yes. A missing
    key is false. Without readable JSON the result is null, or an error where ``strict``."""
    parsed = F.from_json(json_part(text), "map<string,string>")
    parsed = F.when(F.coalesce(F.size(parsed), F.lit(-1)) >= 0, parsed)
    if strict:
        parsed = F.coalesce(parsed, F.raise_error(F.lit("an answer holds no JSON object")).cast("map<string,string>"))

    def yes(value: Column) -> Column:
        low = F.lower(strip(F.coalesce(value, F.lit(""))))
        return low.isin(YES, "yes") if exact else low.contains(YES) | low.contains("yes")

    found = F.map_from_arrays(F.array(*map(F.lit, categories)), F.array(*[yes(parsed[c]) for c in categories]))
    return F.when(parsed.isNotNull(), found)


def first_match(text: Column, candidates: list[str]) -> Column:
    """First candidate that holds the text or is held by it; an empty text takes the first."""
    text = F.coalesce(text, F.lit(""))
    fits = F.filter(F.array(*map(F.lit, candidates)), lambda c: text.contains(c) | c.contains(text))
    return F.try_element_at(fits, F.lit(1))
