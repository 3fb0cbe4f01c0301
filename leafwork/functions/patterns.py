"""Patterns and word lists that decide what a piece of text is. They must stay as they are for right results."""

# Fixed values. Patterns are in Java's syntax; (?U) gives \w, \b, \s and \d their Unicode meaning.
WORD = r"(?U)\b[A-Za-z]{3,}\b"
SHORT_TOKEN = r"(?U)\b[A-Za-z]{1,2}\b"
ANY_WORD = r"(?U)\b[A-Za-z]{1,}\b"
ACRONYM = r"(?U)\b[A-Z]{2,8}\b"
GLOSSARY_TERM = r"(?U)\b[A-Z]{2,8}s?\b"
CJK = "[一-鿿]"
LATIN = "[A-Za-z]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
MATH_CHARS = "≤≥≈≠∑∫√±×÷∗−′″"

URL = r"(?i)https?://|www\."
CODE = r"(?U)[{};<>]|\b(def|class|return|import)\b"
CITATION = r"(?U)^\s*(\[[0-9,\- ]+\]|\([A-Za-z].*\d{4}.*\))\s*$"
CAPTION = r"(?iU)^\s*(fig(?:ure)?|table)\s*[\.\-: ]*([ivxlcdm]+|\d+)\b"
TABLE_CAPTION = r"(?iU)^\s*TABLE\s+([IVXLCM]+|\d+)(?:\s*[:.\-]?\s*.*)?$"
TABLE_NOTE = r"(?iU)^\s*Note\s*[:\-]?\s*\S"
TABLE_HEADER = (
    r"(?iU)\bnotation\b.*\bdefinition\b|\bdefinition\b.*\bnotation\b|\b(method|metric|measured|parameter|prototype|component)\b[^.;:\n]{0,48}\b"
    r"(accuracy|precision|recall|f1|auc|latency|throughput|mean|max|min|std|variance|result)\b"
)
NUMERIC_ROW = r"(?U)^(?:\S+\s+)?(?:\d+(?:\.\d+)?\s+){2,}\d+(?:\.\d+)?$"
SYMBOLIC_ROW = r"(?U)^(?:[A-Za-z][\w\-/*']*\s+){1,6}(?:[×x✓\-]|[0-9]+(?:\.[0-9]+)?)(?:\s+[×x✓\-]|[0-9]+(?:\.[0-9]+)?)+$"
SYMBOL_TOKEN = r"(?U)(?:^|[\s|,;:/()\[\]{}])(?:x|X|×|✓)(?=$|[\s|,;:/()\[\]{}])"
NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"
TABLE_VERB = (
    r"(?iU)\b(list|lists|show|shows|present|presents|illustrate|illustrates|compare|compares|summarize|summarizes|report|reports|give|gives|"
    r"describe|describes|outline|outlines|detail|details|discuss|discusses|analyze|analyzes|evaluate|evaluates|investigate|investigates|examine|examines)\b"
)
FORMULA = r"(?U)\b[A-Za-z]\s*=\s*[A-Za-z0-9]|\$[^$]+\$|\\\([^)]*\\\)"
LATEX_COMMAND = r"\\(frac|sum|int|alpha|beta|gamma|theta|lambda|mu|sigma|pi|cdot|times|leq|geq)"
CALL = r"(?U)\b[A-Za-z]\s*\([A-Za-z0-9,+\-*/\s]+\)"
DISPLAY_EQUATION = r"(?U)[A-Za-z0-9\)\]}]\s*=\s*[A-Za-z0-9\(\[{]"
MATH_STRUCTURE = r"[{}_^]|\\[A-Za-z]+|[" + MATH_CHARS + "]"
OPTIMUM = r"(?iU)\b(argmax|argmin|min|max|s\.t\.)\b"
NARRATIVE_HINT = (
    r"(?iU)\b(choose|chooses|compute|computes|computed|send|sends|sent|receive|receives|received|encrypt|encrypts|encrypted|decrypt|decryption|"
    r"let|then|after|before|where|thus|assume|assumes|assuming|note|noted|count|update|set|sets|check|checks)\b"
)
PROSE_LEAD = r"(?iU)^\s*(where|if|when|let|thus|then|for|assuming|suppose|consider|set|define|denote|given)\b"
PROSE_HINT = r"(?iU)\b(where|if|when|let|thus|then|assume|assuming|note|denote|denotes|define|defined|represents|subject to|s\.t\.)\b"
THEOREM = r"(?iU)^\s*(theorem|proof|lemma|corollary|proposition|definition)\b"
FRAGMENT_VERB = (
    r"(?iU)\b(decrypt|decrypts|encrypted|encrypt|encrypts|compute|computes|computed|find|finds|get|gets|return|returns|send|sends|receive|receives|"
    r"obtain|obtains|choose|chooses|set|sets|check|checks|compare|compares)\b"
)
FRAGMENT_NOUN = r"(?iU)\b(ciphertext|plaintext|protocol|index|variable|value|random|nonce|message)\b"

REFERENCE_HEADING = r"(?iU)^\s*(?:(?:section\s+)?(?:\d+(?:\.\d+)*|[ivxlcdm]+)\s*[\).:\-]?\s*)?(references?|bibliography|works\s+cited|literature|参考文献)\s*[:.]?\s*$"
REFERENCE_START = r"(?U)^\s*(\[\d{1,3}\]|\d{1,2}[.)])\s+"
BRACKET_START = r"(?U)^\s*\[\d{1,3}\]\s+"
YEAR = r"(?U)\b(19|20)\d{2}\b"
VENUE = r"(?iU)\b(ieee|acm|springer|elsevier|wiley|journal|transactions|proc\.?|conference|symposium|doi|arxiv|vol\.?\s*\d+|no\.?\s*\d+|pp\.?\s*\d+)\b"
AUTHOR = r"(?U)\b(?:[A-Z][a-zA-Z'`-]{1,24},\s*(?:[A-Z]\.\s*){1,3}|[A-Z][a-zA-Z'`-]{1,24}\s+et al\.)"
PROPOSAL = r"(?U)\b(we|our|propose|design|present|develop|introduce|suggest)\b"
PROPOSAL_VERBS = ["propose", "design", "present", "develop", "introduce", "suggest", "we "]

HEADER_HINT = r"(?iU)\b(ieee|transactions|journal|vol\.?|no\.?|january|february|march|april|may|june|july|august|september|october|november|december)\b"
FOOTER_HINT = r"(?iU)\b(authorized licensed use limited to|downloaded on|ieee xplore|restrictions apply|copyright|all rights reserved)\b"
LICENCE = r"(?iU)\bauthorized licensed use limited to\b|\bdownloaded on\b.*\bieee xplore\b|\bieee xplore\b.*\brestrictions apply\b|\bpersonal use is permitted\b|\brepublication/?redistribution\b"
LICENCE_SIGNALS = ["ieee xplore", "downloaded on", "restrictions apply", "personal use is permitted"]

ALGORITHM_HEADING = r"(?iU)^\s*(algorithm|alg\.?|算法)\s*[\divxlcdm一二三四五六七八九十]*"
ALGORITHM_IO = r"(?iU)^\s*(input|output|require|ensure|return|输入|输出|返回|初始化|参数)\b"
ALGORITHM_IO_COLON = r"(?iU)^\s*(input|output|require|ensure|return|输入|输出|返回|初始化|参数)\s*[:：]"
ALGORITHM_STEP = r"(?iU)^\s*(\d{1,3}|[ivxlcdm]{1,6})[\).]?\s+\S"
ALGORITHM_CONTROL = r"(?iU)\b(if|then|else|while|repeat|until|return)\b|[:=]{1,2}|<-|->"
ALGORITHM_FOR = r"(?iU)\bfor\s+each\b|\bfor\b[^.;:\n]{0,48}\b(in|to|from)\b"
ALGORITHM_END = r"(?iU)^\s*end\s+(for|while|if|repeat)\b|^\s*结束\b"
NUMBERED_PROSE = r"(?iU)^\s*\d{1,3}[\).]?\s+(we|our)\b"
ACADEMIC_LABEL = r"(?iU)^\s*(?:the\s+)?(definition|theorem|lemma|corollary|proposition|proof|remark|example)\b"
BULLET = r"(?iU)^\s*(?:[-*•]|(?:\d{1,3}|[ivxlcdm]{1,6})[\).])\s+[A-Za-z]"
NUMBERED_LINE = r"(?iU)^\s*(?:\(?\d{1,3}\)?|[ivxlcdm]{1,6})[\).:]\s+[A-Za-z]"
LIST_LEAD_IN = r"(?iU)\b(contribution|contributions|our main|we propose|we design|we study|we perform)\b"
ITEM_MARKER = r"(?U)(?:^|[\n\r;；,，。：:\.]\s*)((?:[（(]?\d{1,2}[）)])|(?:\d{1,2}[\.、:：]))"
TABLE_CONTINUATION = r"(?iU)\b(that|which|where|if|then|means?|mean|known|stored|locally|initially|example\d*|suppose|assuming|assume|let|denote|denotes|recording|variable)\b"
METRIC_TERMS = ["accuracy", "precision", "recall", "f1", "auc", "latency", "throughput", "mean", "max", "min", "std", "variance", "error", "mse", "mae"]
METHOD_TERMS = ["method", "baseline", "model", "algorithm", "metric", "parameter", "setting", "dataset", "component"]

STRUCTURE_LINE = r"(?U)^\s*(?:['`‘’•·\-*]\s*)?(?:r\b|[A-Za-z]\[[^\]]+\]|count\(|state\d*\b|next\b|res\b)"
STRUCTURE_TOKEN = r"(?iU)\bcount\s*\(|\bstate\d*\b|\bnext\b|\bres\b|\bminpos\b|[A-Za-z]\[[^\]]+\]|\|\||:=|⊕|←"
HEADING_LINE = r"(?iU)^\s*(?:section\s+)?[ivxlcdm0-9.\-: ]+[A-Za-z][A-Za-z \-']+$"
LIST_ITEM = r"(?iU)^\s*(?:[a-z]|[ivxlcdm]+|\d{1,3})[\).:]\s+"
OPEN_END = r"(?U)(?:[-=+*/^_⊕←,;:.\(\[])\s*$"
JOINER_END = r"(?iU)\b(?:for|where|then|that|with|s\.t)\s*$"

META_INLINE = r"(?iU)[（(][^()（）]{0,260}(后续内容保持原文|严格遵循要求|翻译要求|输出要求|不要输出|不要翻译|strict retry mode|system prompt|preferred terms|mathseg\d+token)[^()（）]{0,260}[）)]"
META_KEYS = ["后续内容保持原文", "原文未完成状态", "严格遵循要求", "翻译要求", "输出要求", "不要输出", "不要翻译", "术语=", "terms=", "strict retry mode", "system prompt", "preferred terms", "style:"]
CONTINUATION_MARKER = r"(?iU)^[（(]?\s*(?:续上行|接上行|续行|承上|同上|见上行|continued(?:\s+above)?|same as above|ditto)\s*[）)]?$"
DOTS = r"^[.。·…]{2,}$"
MATH_TOKEN = r"(?iU)mathseg\d+token"
TARGET_HEADING = r"(?iU)^\s*(?:section\s+)?(?:\d+(?:\.\d+)*|[ivxlcdm]+)\s*[\).:：\-]?\s*(?:相关工作|参考文献|引言|摘要|结论|实验(?:评估|结果)?|方法|预备知识|问题定义|系统模型)\s*$"
TARGET_HEADINGS = ["相关工作", "参考文献", "引言", "摘要", "结论", "实验", "实验评估", "实验结果", "方法", "预备知识", "问题定义", "系统模型"]
FRAGMENT_TAILS = [" for both the", " for the", " of the", " and the", " to the", " in the", ","]
FRAGMENT_TAIL = r"(?U)(?:\b(for both the|for the|of the|and the|to the|in the|with the)\s*|[,;:])$"

SKIP_LABELS = ["header", "footer", "page_number", "page number", "footnote", "watermark"]
TABLE_LABELS = ["table", "tab", "table region", "tabular", "表格"]
REFERENCE_LABELS = ["reference", "references", "reference list", "bibliography", "参考文献"]
DEFAULT_STYLES = ["", "academic_conservative", "academic", "default"]
EVENT_KINDS = ["page_ready", "page_failed", "provider_switched", "session_expiring", "session_ready", "session_failed", "progress"]
SECTION_HEADINGS = {
    "ABSTRACT": "摘要", "CONCLUSION": "结论", "CONCLUSIONS": "结论", "DISCUSSION": "讨论", "EVALUATION": "实验评估", "EXPERIMENT": "实验", "EXPERIMENTS": "实验", "INTRODUCTION": "引言",
    "METHOD": "方法", "METHODOLOGY": "方法", "PRELIMINARIES": "预备知识", "PROBLEM STATEMENT": "问题定义", "RELATED WORK": "相关工作", "RELATED WORKS": "相关工作", "RESULTS": "结果", "SYSTEM MODEL": "系统模型",
}
SHORT_PHRASES = {
    "as an example": "例如", "easy to see that": "易得", "for example": "例如", "hence we have": "则有", "it is easy to see that": "易得", "note that": "注意", "notice that": "注意",
    "then we have": "则有", "thus we have": "由此可得", "thus we obtain": "由此可得", "we have": "有", "which directly leads to": "由此可得",
}
