"""Text of records: paths, labels, sequence codes, numeric boxes in prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import col, first_present

NUMBERS = r"\[\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\]"
#: A box in a prompt: numbers, or what stands for hidden ones.
TOKEN = r"\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]|\[\s*x1\s*,\s*y1\s*,\s*x2\s*,\s*y2\s*\]|\[MASK\]"
NUMERIC = r"\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]"
INFECTION_ZH, TUMOR_ZH = "感染", "肿瘤"
#: The same words, UTF-8 read as GBK. Fixed values.
INFECTION_MISREAD, TUMOR_MISREAD = "鎰熸煋", "鑲跨槫"
START, END = "<|vision_start|>", "<|vision_end|>"


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match; NULL without one."""
    c = col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def image_path(text: Column | str) -> Column:
    return F.trim(extract(text, r"(?s)<\|vision_start\|>(.*?)<\|vision_end\|>"))


def prompt_text(text: Column | str) -> Column:
    return F.trim(F.split_part(col(text), F.lit(START), F.lit(1)))


def box_in_text(text: Column | str) -> Column:
    """The first box found: after ``bbox:``, after ``"bbox":``, else any; NULL without one."""
    t = col(text)
    ways = (rf"(?is)bbox\s*[:：]\s*{NUMBERS}", rf'(?is)"bbox"\s*:\s*{NUMBERS}', rf"(?s){NUMBERS}")
    side = lambda way, k: F.regexp_extract(t, way, k).try_cast("int")
    boxes = [F.when(t.rlike(w), F.struct(*(side(w, k + 1).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))) for w in ways]
    return F.coalesce(*boxes)


def label(text: Column | str) -> Column:
    """infection (looked for first) or tumor; NULL if neither is named."""
    t = col(text)
    low = F.lower(t)
    infection = low.contains("infection") | t.contains(INFECTION_ZH) | t.contains(INFECTION_MISREAD)
    tumor = low.contains("tumor") | low.contains("tumour") | t.contains(TUMOR_ZH) | t.contains(TUMOR_MISREAD)
    return F.when(infection, "infection").when(tumor, "tumor")


def sequence_token(text: Column | str) -> Column:
    return F.upper(extract(text, r"\b([Tt][12](?:WI)?)\b"))


def sequence_code(seq: Column | str) -> Column:
    """T1, T2 or the text in upper case; '' for NULL."""
    s = F.upper(F.coalesce(col(seq).cast("string"), F.lit("")))
    named = lambda k: s.contains(f"T{k}") | s.endswith(f"_{k}") | (s == k)
    return F.when(named("1"), "T1").when(named("2"), "T2").otherwise(s)


def stem(path: Column | str) -> Column:
    """File name without its folder and last suffix."""
    return F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def sequence_of_path(path: Column | str, anchored: bool = True) -> Column:
    """From ``<digits>_1`` or ``_2`` at the start of the file name (anywhere if not anchored), else from T1 or T2 in the path."""
    p, name = F.upper(col(path)), F.upper(stem(path))
    digit = F.regexp_extract(name, r"^\d+_([12])(?:[_-]|$)" if anchored else r"\d+_([12])(?:[_-]|$)", 1)
    return F.when(digit != "", F.concat(F.lit("T"), digit)).when(p.contains("T1"), "T1").when(p.contains("T2"), "T2").otherwise("")


def slice_index(path: Column | str) -> Column:
    """The number after z, slice, layer or s in a file name, tried in this order."""
    name = stem(path)
    before, after = r"(?i)(?:^|[_-])", r"(\d+)(?:[_-]|$)"
    return F.coalesce(*(extract(name, before + mark + after).try_cast("int") for mark in ("z", "slice[_-]?", "layer[_-]?", "s")))


def patient_id(text: Column | str) -> Column:
    """The last run of six digits or more."""
    return F.try_element_at(F.regexp_extract_all(col(text).cast("string"), F.lit(r"\d{6,}"), F.lit(0)), F.lit(-1))


def label_of_case(case_id: Column | str) -> Column:
    c = col(case_id)
    return F.when(c.startswith("infection"), "infection").when(c.startswith("tumor"), "tumor").otherwise("")


def case_parts(name: Column | str) -> Column:
    """A case name cut at its last underscore: struct of patient_id and seq_id (NULL without an underscore)."""
    c = stem(name)
    return F.struct(extract(c, r"^(.*)_([^_]*)$", 1).alias("patient_id"), extract(c, r"^(.*)_([^_]*)$", 2).alias("seq_id"))


def file_id(path: Column | str) -> Column:
    """File name without ``.nii.gz`` or its last suffix."""
    return F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)$", 1), r"(\.nii\.gz|(?<=.)\.[^.]*)$", "")


def box_text(b: Column) -> Column:
    return F.format_string("[%d,%d,%d,%d]", *(b[n].cast("bigint") for n in ("x1", "y1", "x2", "y2")))


def _parts(text: Column | str) -> tuple[Column, Column]:
    """What stands between box tokens, and the tokens."""
    t = col(text)
    return F.split(t, TOKEN, -1), F.regexp_extract_all(t, F.lit(f"({TOKEN})"), F.lit(1))


def _rejoin(between: Column, tokens: Column) -> Column:
    following = F.transform(tokens, lambda x, i: F.concat(x, F.element_at(between, (i + 2).cast("int"))))
    return F.concat(F.element_at(between, 1), F.array_join(following, ""))


def replace_first_boxes(text: Column | str, replacement: Column, count: int = 2) -> Column:
    """The first ``count`` box tokens replaced."""
    between, tokens = _parts(text)
    return _rejoin(between, F.transform(tokens, lambda x, i: F.when(i < count, replacement).otherwise(x)))


def replace_nth_box(text: Column | str, replacement: Column, n: int = 2, else_first: bool = False) -> Column:
    """The n-th box token replaced; with ``else_first`` a text with fewer has its first ones replaced."""
    between, tokens = _parts(text)
    nth = _rejoin(between, F.transform(tokens, lambda x, i: F.when(i == n - 1, replacement).otherwise(x)))
    return F.when(F.size(tokens) < n, replace_first_boxes(text, replacement)).otherwise(nth) if else_first else nth


def hide_box(text: Column | str, replacement: str = "[x1,y1,x2,y2]") -> Column:
    """The first numeric box replaced."""
    return F.regexp_replace(col(text), rf"(?s)\A(.*?){NUMERIC}", "$1" + replacement.replace("\\", "\\\\").replace("$", "\\$"))


def has_numeric_box(text: Column | str) -> Column:
    return col(text).rlike(NUMERIC)


def label_zh(c: Column | str) -> Column:
    return F.when(col(c) == "infection", INFECTION_ZH).when(col(c) == "tumor", TUMOR_ZH)


#: Wordings of prompts and answers. Fixed values, as the models of this format were trained on them.
SEQ_PART = "序列为%s。"
ASK = "请判断这个病灶属于感染还是肿瘤。只输出感染或肿瘤。"
BOX_PROMPT = "这是一幅脊椎的磁共振图像，%s其中病灶的位置按照[x1,y1,x2,y2]的格式在%s。"
CROP_PROMPT = "这是一幅脊椎磁共振图像中的病灶区域，%s"
LEGACY_ANSWER = "这个病灶的类型为%s。"
LEGACY_PROMPT = "现在你是一个骨科专家，这是一幅脊椎的磁共振图像,%s该图像中可能包含了数个病灶，然后我会将最大病灶的坐标位置按照[x1,y1,x2,y2]的格式给出：该张图片中的最大病灶在%s这个位置。请你帮我判断这个病灶属于感染还是肿瘤。"
REGION = "候选病灶区域%d/%d"
REGION_NOTE = "\n补充说明：当前仅分析%s，坐标为%s。请忽略其他区域，仅根据这个框内最主要的病灶表现判断属于感染还是肿瘤；如果该框不像有效病灶，请输出'无明确病灶'。"
REGION_PROMPT = "现在你是一个骨科专家，这是一幅脊椎的磁共振图像。当前仅分析%s，其坐标为%s。请只关注这个框内区域，并判断该区域最可能属于感染还是肿瘤。"


def build_prompt(seq: Column | str, b: Column | None = None, style: str = "clean") -> Column:
    """A question about a box of an image, or about a cropped region where no box is given; ``legacy`` words the former at length."""
    s = F.coalesce(F.when(col(seq) != "", F.format_string(SEQ_PART, col(seq))), F.lit(""))
    if b is not None and style == "legacy":
        return F.format_string(LEGACY_PROMPT, s, box_text(b))
    head = F.format_string(CROP_PROMPT, s) if b is None else F.format_string(BOX_PROMPT, s, box_text(b))
    return F.concat(head, F.lit(ASK))


def region_prompt(prompt: Column | str, b: Column, rank: Column, total: Column) -> Column:
    """A prompt about one of several regions: a given one with its second box replaced and a note, else a question of its own."""
    where, at = F.format_string(REGION, rank.cast("bigint"), total.cast("bigint")), box_text(b)
    noted = F.concat(replace_nth_box(prompt, at, 2), F.format_string(REGION_NOTE, where, at))
    return F.when(F.coalesce(col(prompt), F.lit("")) != "", noted).otherwise(F.format_string(REGION_PROMPT, where, at))


def record_image_path(prefix: str, split: Column | str, name: Column | str) -> Column:
    return F.concat_ws("/", F.lit(prefix.rstrip("/\\")), col(split), F.lit("image"), col(name))


def score_text(c: Column | str) -> Column:
    """A number with twelve significant digits, without closing zeros; with an exponent below 1e-4 and from 1e12."""
    x = col(c).cast("double")
    short = F.format_string("%.11e", x).cast("double")
    plain = F.regexp_replace(F.regexp_replace(short.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    far = F.regexp_replace(F.format_string("%.11e", x), r"\.?0+e", "e")
    return F.when(short == 0, "0").when(F.abs(short).between(1e-4, 999_999_999_999), plain).otherwise(far)


def build_answer(c: Column | str, style: str = "short", original: Column | str | None = None) -> Column:
    zh = label_zh(c)
    if style == "legacy":
        return F.format_string(LEGACY_ANSWER, zh)
    return F.coalesce(first_present(original), zh) if style == "original" and original is not None else zh


def conversation(sample_id: Column, prompt: Column, path: Column, answer: Column) -> Column:
    """A record: id and a pair of turns, the first with the image between its marks."""
    user = F.concat(prompt, F.lit(START), path, F.lit(END))
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return F.struct(sample_id.cast("string").alias("id"), F.array(turn("user", user), turn("assistant", answer)).alias("conversations"))


def slug(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(col(c)), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def indexed_stem(index: Column, path: Column | str, limit: int = 80) -> Column:
    """Six digits and a file-safe stem."""
    return F.format_string("%06d_%s", index.cast("bigint"), F.substring(F.regexp_replace(stem(path), r"[^0-9A-Za-z._-]+", "_"), 1, limit))


def remap_path(path: Column | str, old: str, new: str) -> Column:
    p = col(path)
    return F.when(p.startswith(old), F.concat(F.lit(new.rstrip("/")), F.lit("/"), F.ltrim(F.substring(p, len(old) + 1, 1 << 20), F.lit("/")))).otherwise(p)


def sample_of_indexed_path(path: Column | str) -> Column:
    s = stem(path)
    return F.coalesce(extract(s, r"^\d{6}_(.+)$"), s)


#: Words for one lesion and for several. Fixed values.
SINGLE = ("single", "single_lesion", "unifocal", "solitary", "0")
MULTIPLE = ("multiple", "multiple_lesions", "multifocal", "multi_lesion", "1")


def lesion_pattern(c: Column | str) -> Column:
    """single, multiple, or '' for any other word."""
    word = F.translate(F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit("")))), "- ", "__")
    return F.when(word.isin(*SINGLE), "single").when(word.isin(*MULTIPLE), "multiple").otherwise("")


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def record_keys(sample_id: Column | str, path: Column | str, index: Column) -> Column:
    """Keys by which a record's file may be known, in lower case: its name, its stem, and the indexed stem without and with suffix."""
    p = F.translate(col(path), "\\", "/")
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    own = indexed_stem(index, F.coalesce(first_present(sample_id), stem(p)))
    suffix = _suffix(p)
    keys = F.array(name, stem(p), own, F.when(suffix != "", F.concat(own, suffix)))
    return F.array_distinct(F.transform(F.array_compact(keys), F.lower))


def file_keys(path: Column | str) -> Column:
    """Keys by which a file may be known, the most telling first: path, name, stem, stem without its index."""
    p = F.translate(col(path), "\\", "/")
    return F.array_distinct(F.array(p, F.regexp_extract(p, r"([^/]*)$", 1), stem(p), sample_of_indexed_path(p)))


def first_number(c: Column | str) -> Column:
    return extract(c, r"([-+]?\d+(?:\.\d+)?)").try_cast("double")


def number_list(c: Column | str) -> Column:
    """Positive whole numbers of a comma-separated list, ascending, each once."""
    values = F.transform(F.split(col(c), ","), lambda x: F.trim(x).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x > 0)))


def float_list(c: Column | str) -> Column:
    """Numbers of a comma-separated list, in order; what isn't a number goes."""
    values = F.transform(F.split(col(c), ","), lambda x: F.trim(x).try_cast("double"))
    return F.filter(values, lambda x: x.isNotNull())


def record_id(c: Column | str, index: Column) -> Column:
    return F.coalesce(first_present(c), F.concat(F.lit("sample_"), index.cast("string")))


def retagged(prefix: str, index: Column) -> Column:
    return F.format_string(prefix + "_%06d", index.cast("bigint"))
