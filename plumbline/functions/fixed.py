"""Lists and patterns that results depend on, each stated once, in the order in which they are defined to apply."""

from __future__ import annotations

# Elements whose content is shown as it stands or not at all, and elements without content.
VERBATIM = ("script", "style", "pre", "code", "textarea", "option", "noscript")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

# Formula environments in which a doubled backslash is a line break.
ENVIRONMENTS = (
    "matrix", "pmatrix", "bmatrix", "Bmatrix", "vmatrix", "Vmatrix", "smallmatrix", "array", "aligned", "align", "align*", "alignat", "alignat*",
    "alignedat", "gathered", "gather", "gather*", "cases", "split", "subarray", "dcases", "rcases", "eqnarray", "eqnarray*", "multline", "multline*", "CD",
)

# Leak rules, as Python's re reads them.
DOUBLED_BACKSLASH = r"\\\\[A-Za-z]+"
LATEX_IN_PROSE = r"\\[A-Za-z]{2,}|\\[^A-Za-z\s]"
PROSE_SCRIPT = r"[_^]\{[^{}\s]{1,32}\}"
MD_BOLD = r"\*\*[^*\n]{1,80}\*\*"
MD_ITALIC = r"(?<![\w\\])_(摘要|索引词|∗|[\u4e00-\u9fff]{1,20})_(?![\w])"
MD_QUOTE = r"^>\s"
MD_STRIKE = r"~~[^\n~]{1,60}~~"
STRAY_GT = r"<img\b[^>]*?>>"
LEAKED_PATHS = r"_extracted[\w\-]*|assets/raw|assets\\raw|[A-Za-z]:\\|/mnt/|_work\\|_fixwork|_bak_fix|_extract\\|_translate\\"
REF_HEADING = r"参考文献|REFERENCES|References"
REF_ENTRY = r"\[\s*\d+\s*\]|\b(?:19|20)\d{2}\b|等[.．]|et al"
REF_PLACEHOLDER = r"保持原文|按原文保留|见下方原文|不作翻译|原文清单|此处省略|详见原文|原文见|未翻译|见原文"
REF_REACH, REF_HEAD_REACH = 3000, 400

# Emphasis between underscores: what makes an underscore part of a word, what only formulas hold, and the longest reach.
IDENTIFIER = "0-9A-Za-z\u0370-\u03ff\u1f00-\u1fff\u2070-\u209f\U0001d400-\U0001d7ff"
FORMULA_SIGNS = "()[]{}=<>^\\|"
EMPHASIS_GAP, EMPHASIS_INNER = 60, 40

# Captions: separators after the number, how far after an image and how long.
CAPTION_MARKS = "：:．.、,，\u3000"
CAPTION_WINDOW, CAPTION_SHORT, CAPTION_SHOWN, OTHER_SHOWN = 1400, 40, 110, 70
FIGURE = r"图\s*(\d+)"
FIGURE_WITH_MARK = r"图\s*(\d+)\s*[：:．.、，]"
FIGURE_AT_LINE_START = r"(?:^|\n)[ \t>]*图\s*(\d+)"
HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"

# Names that an image can go by: kind, form, pattern, whether letter case matters; the first that occurs counts.
IMAGE_NAMES = (
    ("eq", "zh_eq", r"(?:公式|式)\s*[:：]?\s*\(?(\d{1,3})\)?", True),
    ("eq", "asset_eq", r"\b(?:eq|equation)[_\-\s]*(\d{1,3})\b", False),
    ("tab", "zh_tab", r"(?:表)\s*[:：]?\s*(\d{1,3})", True),
    ("tab", "asset_tab", r"\b(?:tab|table)[_\-\s]*(\d{1,3})\b", False),
    ("fig", "zh_fig", r"图\s*(\d{1,3})\s*[:：]", True),
    ("fig", "zh_fig_bare", r"图\s*(\d{1,3})", True),
    ("fig", "asset_fig", r"\b(?:fig|figure)[_\-\s]*(\d{1,3})\b", False),
)
CONTEXT_WINDOW, CONTEXT_KEPT, NAME_AFTER, CAPTION_BEFORE = 3000, 300, 140, 200
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))

# JPEG: frame headers, which hold the size, and markers without a length.
JPEG_FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
JPEG_BARE = (0x01, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9)
