"""Facts about formats, and the rules' lists and thresholds."""

from __future__ import annotations

SEVERITIES = ("info", "low", "medium", "high", "critical")
RANK = {name: rank for rank, name in enumerate(SEVERITIES)}

# File extensions of model artifacts.
EXTENSIONS = ("safetensors", "gguf", "bin", "pt", "pth", "ckpt", "pkl", "pickle")

# Leading bytes (hex) and what they begin, first match wins.
MAGICS = (
    ("7f454c46", "an ELF executable"),
    ("feedface", "a Mach-O executable"),
    ("feedfacf", "a Mach-O executable"),
    ("cefaedfe", "a Mach-O executable"),
    ("cffaedfe", "a Mach-O executable"),
    ("cafebabe", "a universal Mach-O executable"),
    ("504b0304", "a ZIP archive"),
    ("1f8b", "a gzip stream"),
    ("425a68", "a bzip2 stream"),
    ("fd377a585a", "an xz stream"),
    ("377abcaf271c", "a 7-Zip archive"),
    ("255044462d", "a PDF document"),
    ("89504e47", "a PNG image"),
    ("8002", "a pickle stream"),
    ("8003", "a pickle stream"),
    ("8004", "a pickle stream"),
    ("8005", "a pickle stream"),
    ("23212f", "a script"),
    ("4d5a", "a DOS or PE executable"),
)

# Bytes an element of each safetensors dtype takes.
DTYPE_SIZES = {
    "F64": 8, "I64": 8, "U64": 8,
    "F32": 4, "I32": 4, "U32": 4,
    "F16": 2, "BF16": 2, "I16": 2, "U16": 2,
    "I8": 1, "U8": 1, "BOOL": 1, "F8_E4M3": 1, "F8_E5M2": 1,
}
# Those whose elements are decoded.
DECODABLE = ("F64", "F32", "F16", "BF16", "I64", "I32", "I16", "I8", "U8", "BOOL")
# Those whose byte entropy means something.
INTEGER_DTYPES = ("I8", "U8", "BOOL", "I16", "I32", "I64")

# Id, name, how it is decoded (a dtype, a block kind, or nothing), elements and bytes of a block if known.
GGML_TYPES = (
    (0, "F32", "F32", 1, 4),
    (1, "F16", "F16", 1, 2),
    (2, "Q4_0", "Q4_0", 32, 18),
    (3, "Q4_1", "Q4_1", 32, 20),
    (6, "Q5_0", "Q5_0", 32, 22),
    (7, "Q5_1", "Q5_1", 32, 24),
    (8, "Q8_0", "Q8_0", 32, 34),
    (9, "Q8_1", None, None, None),
    (10, "Q2_K", None, 256, 84),
    (11, "Q3_K", None, 256, 110),
    (12, "Q4_K", None, 256, 144),
    (13, "Q5_K", None, 256, 176),
    (14, "Q6_K", None, 256, 210),
    (15, "Q8_K", None, 256, 292),
    (16, "IQ2_XXS", None, None, None),
    (17, "IQ2_XS", None, None, None),
    (18, "IQ3_XXS", None, None, None),
    (19, "IQ1_S", None, None, None),
    (20, "IQ4_NL", None, None, None),
    (21, "IQ3_S", None, None, None),
    (22, "IQ2_S", None, None, None),
    (23, "IQ4_XS", None, None, None),
    (24, "I8", "I8", 1, 1),
    (25, "I16", "I16", 1, 2),
    (26, "I32", "I32", 1, 4),
    (27, "I64", "I64", 1, 8),
    (28, "F64", "F64", 1, 8),
    (30, "BF16", "BF16", 1, 2),
)

# Modules and builtins whose reference in a pickle is dangerous.
DANGEROUS_MODULES = (
    "os", "posix", "nt", "subprocess", "sys", "socket", "shutil", "pty", "ctypes", "commands",
    "popen2", "webbrowser", "importlib", "runpy", "code", "codeop", "multiprocessing",
)
DANGEROUS_BUILTINS = ("eval", "exec", "execfile", "compile", "getattr", "setattr", "__import__", "globals", "vars", "open", "input")

# Secret rules in order: label, prefixes, least length, exact length, what the rest must be, confidence.
SECRET_RULES = (
    ("Hugging Face token", ("hf_",), 34, None, "[A-Za-z0-9]", "high"),
    ("Hugging Face organisation token", ("api_org_",), 30, None, None, "high"),
    ("AWS access key id", ("AKIA", "ASIA"), None, 20, "[A-Z0-9]", "high"),
    ("GitHub token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), 36, None, None, "high"),
    ("GitLab token", ("glpat-",), 24, None, None, "high"),
    ("Slack token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-"), None, None, None, "high"),
    ("Docker token", ("dckr_pat_",), 20, None, None, "high"),
    ("Anthropic API key", ("sk-ant-",), 20, None, None, "high"),
    ("API secret key", ("sk-",), 20, None, None, "medium"),
    ("Google API key", ("AIza",), 35, None, None, "medium"),
)
GENERIC_SECRET = ("high-entropy string", 32, 4.0, "low")

# Calls that are dangerous in shipped Python.
PY_CALLS = (
    ("os.system(", "a shell command"),
    ("os.popen(", "a shell command"),
    ("os.execv", "a program"),
    ("os.spawn", "a program"),
    ("subprocess.", "a program"),
    ("pty.spawn(", "a terminal"),
    ("eval(", "evaluated code"),
    ("exec(", "evaluated code"),
    ("compile(", "compiled code"),
    ("__import__(", "a computed import"),
    ("importlib.import_module(", "a computed import"),
    ("pickle.loads(", "unpickled data"),
    ("marshal.loads(", "unmarshalled code"),
    ("base64.b64decode(", "decoded data"),
    ("codecs.decode(", "decoded data"),
    ("ctypes.", "native code"),
    ("socket.socket(", "a network socket"),
    ("urllib.request.urlopen(", "a network request"),
    ("urlopen(", "a network request"),
    ("requests.get(", "a network request"),
    ("requests.post(", "a network request"),
    ("httpx.", "a network request"),
    ("setattr(builtins", "a changed builtin"),
)
# Names in templates that reach out of them.
TEMPLATE_GADGETS = (
    "__class__", "__mro__", "__bases__", "__base__", "__subclasses__", "__globals__", "__builtins__", "__import__", "__init__",
    "__reduce__", "__getattribute__", "__dict__", "func_globals", "_TemplateReference__context",
)
TEMPLATE_GLOBALS = ("lipsum", "cycler", "joiner")
TEMPLATE_DYNAMIC = ("|attr", "| attr", "attr(", "getattr(")

# Files that are looked at beside the artifacts.
CONFIG_FILES = (
    "config.json", "tokenizer_config.json", "preprocessor_config.json", "processor_config.json", "feature_extractor_config.json",
    "image_processor_config.json", "model_index.json",
)
SIBLING_FILES = (
    "config.json", "generation_config.json", "tokenizer_config.json", "special_tokens_map.json", "tokenizer.json", "model_index.json",
    "chat_template.jinja", "chat_template.json", "adapter_config.json", "preprocessor_config.json", "processor_config.json",
)
TEMPLATE_FILES = ("chat_template.jinja", "chat_template.json")
# What a tensor that one side lacks may be tied to.
TIED = {"lm_head.weight": ("wte.weight", "embed_tokens.weight")}

MAX_TEXT = 4 << 20
#: Bytes that a pickle in a zip may inflate to: more is reported, not read.
MAX_ENTRY = 256 << 20
MAX_REGIONS, MAX_EVIDENCE, MAX_STREAMS = 16, 32, 64
MAX_PY, MAX_TEMPLATE, MAX_ALIASES, MAX_CONTRADICTIONS = 20, 12, 5, 3
EPSILON = 2.220446049250313e-16
