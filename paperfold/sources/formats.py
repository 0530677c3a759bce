"""File extensions, how each is shown, and media types."""

PDF = (".pdf",)
IMAGE = (".apng", ".avif", ".bmp", ".gif", ".ico", ".jpeg", ".jpg", ".png", ".svg", ".webp")
AUDIO = (".aac", ".flac", ".m4a", ".mp3", ".oga", ".ogg", ".opus", ".wav")
VIDEO = (".m4v", ".mov", ".mp4", ".ogv", ".webm")
HTML = (".htm", ".html", ".xhtml")
DELIMITED = {".csv": ",", ".psv": "|", ".tab": "\t", ".tsv": "\t"}
OFFICE = (
    ".doc", ".docx", ".eml", ".epub", ".heic", ".heif", ".msg", ".ods", ".odt", ".p7s",
    ".ppt", ".pptx", ".rtf", ".tif", ".tiff", ".xls", ".xlsm", ".xlsx",
)
TEXT = (
    ".c", ".cc", ".cfg", ".cpp", ".cs", ".cxx", ".go", ".ini", ".java", ".js", ".json",
    ".jsonl", ".jsx", ".log", ".markdown", ".md", ".ndjson", ".org", ".php", ".py", ".rb",
    ".rst", ".sh", ".sql", ".srt", ".swift", ".text", ".toml", ".ts", ".tsx", ".txt",
    ".vtt", ".xml", ".yaml", ".yml",
)
UNSUPPORTED = (".7z", ".bin", ".dll", ".exe", ".gz", ".rar", ".so", ".tar", ".tgz", ".zip")

# Extension -> preview kind. No extension is in two of the groups.
PREVIEW_KINDS = {
    **dict.fromkeys(PDF, "pdf"),
    **dict.fromkeys(IMAGE, "image"),
    **dict.fromkeys(AUDIO, "audio"),
    **dict.fromkeys(VIDEO, "video"),
    **dict.fromkeys(HTML, "html"),
    **dict.fromkeys(DELIMITED, "elements"),
    **dict.fromkeys(OFFICE, "elements"),
    **dict.fromkeys(TEXT, "text"),
    **dict.fromkeys(UNSUPPORTED, "unsupported"),
}

# Image types a browser decodes; other images go through the element parser.
BROWSER_IMAGES = (
    "image/apng", "image/avif", "image/bmp", "image/gif", "image/jpeg", "image/png",
    "image/svg+xml", "image/vnd.microsoft.icon", "image/webp", "image/x-icon",
)

# Media types that win over the general table.
MEDIA_TYPES = {
    ".avif": "image/avif",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".eml": "message/rfc822",
    ".epub": "application/epub+zip",
    ".flac": "audio/flac",
    ".heic": "image/heic",
    ".heif": "image/heif",
    ".jsonl": "application/x-ndjson",
    ".log": "text/plain",
    ".m4a": "audio/mp4",
    ".markdown": "text/markdown",
    ".md": "text/markdown",
    ".msg": "application/vnd.ms-outlook",
    ".ndjson": "application/x-ndjson",
    ".ods": "application/vnd.oasis.opendocument.spreadsheet",
    ".odt": "application/vnd.oasis.opendocument.text",
    ".oga": "audio/ogg",
    ".opus": "audio/opus",
    ".org": "text/org",
    ".p7s": "message/rfc822",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".rst": "text/x-rst",
    ".tab": "text/tab-separated-values",
    ".text": "text/plain",
    ".toml": "application/toml",
    ".webm": "video/webm",
    ".webp": "image/webp",
    ".xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".yaml": "application/yaml",
    ".yml": "application/yaml",
}
