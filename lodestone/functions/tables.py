"""Formats, document types, extensions, media types and refusal patterns."""

# Extension to format.
FORMAT_OF_EXTENSION = {
    ".tf": "terraform", ".tfvars": "terraform", ".hcl": "terraform",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".pp": "puppet",
    ".py": "python", ".pyi": "python", ".go": "go", ".rb": "ruby",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".sh": "bash", ".bash": "bash",
    ".csv": "csv",
    ".md": "prose", ".markdown": "prose", ".txt": "prose", ".rst": "prose", ".pdf": "prose",
    ".docx": "prose", ".doc": "prose", ".pptx": "prose", ".ppt": "prose", ".html": "prose",
    ".htm": "prose", ".eml": "prose", ".rtf": "prose",
}
# Whole file name to format.
FORMAT_OF_NAME = {"Dockerfile": "dockerfile", "Containerfile": "dockerfile", "Puppetfile": "ruby"}
# File name prefix to document type, in order.
TYPE_OF_PREFIX = {"adr-": "adr", "INC-": "incident"}
# Path component to document type.
TYPE_OF_FOLDER = {
    "runbooks": "runbook", "incidents": "incident", "playbooks": "playbook",
    "documentation": "documentation", "cmdb": "cmdb", "terraform": "terraform_config",
    "kubernetes": "kubernetes_manifest", "k8s": "kubernetes_manifest", "helm": "helm_values",
    "docker-compose": "docker_compose", "compose": "docker_compose", "puppet": "puppet_config",
    "topology": "architecture", "architecture": "architecture",
}
# Formats whose files are code where nothing else tells.
CODE_FORMATS = ("python", "go", "ruby", "javascript", "typescript", "bash", "dockerfile")
# Extensions accepted on upload.
UPLOAD_EXTENSIONS = (
    ".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".md", ".markdown", ".txt", ".html",
    ".htm", ".rst", ".xml", ".eml", ".rtf", ".csv", ".tf", ".tfvars", ".hcl", ".yaml", ".yml", ".json",
    ".pp", ".conf", ".py", ".pyi", ".go", ".rb", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".sh", ".bash",
)
# Extensions accepted from a drive listing.
LISTING_EXTENSIONS = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".md", ".txt", ".html", ".htm", ".rst", ".csv", ".json", ".xml")
# Native media types that are exported, with the type and extension they become.
NATIVE_PREFIX = "application/vnd.google-apps."
EXPORTS = {
    "application/vnd.google-apps.document": ("text/html", ".html"),
    "application/vnd.google-apps.spreadsheet": ("text/csv", ".csv"),
    "application/vnd.google-apps.presentation": ("text/plain", ".txt"),
}
# Media type of a format.
MIME_OF_FORMAT = {
    "terraform": "text/x-terraform", "yaml": "application/x-yaml", "json": "application/json",
    "puppet": "text/x-puppet", "python": "text/x-python", "go": "text/x-go", "ruby": "text/x-ruby",
    "javascript": "application/javascript", "typescript": "application/typescript",
    "bash": "application/x-sh", "dockerfile": "text/x-dockerfile", "csv": "text/csv", "prose": "text/plain",
}
OTHER_MIME = "application/octet-stream"
# Wordings of an answer that found nothing; letters in either case.
REFUSALS = (
    r"could not find",
    r"i don'?t have",
    r"not in the (?:available |provided )?documents",
    r"no (?:relevant )?information",
    r"unable to (?:find|locate)",
    r"cannot (?:find|locate|answer)",
    r"don'?t have (?:that |this |any )?information",
    r"no (?:matching|specific) (?:information|documents|details)",
)
# Parser class to element type; any other is uncategorised.
ELEMENT_TYPES = {"Title": "Title", "NarrativeText": "NarrativeText", "Table": "Table", "ListItem": "ListItem", "Image": "Image", "Header": "Header", "Footer": "Footer", "PageBreak": "PageBreak", "Formula": "Formula"}
OTHER_ELEMENT = "UncategorizedText"
# Folders that a corpus walk leaves out, and the extensions it takes.
SKIPPED_FOLDERS = ("__pycache__", ".git", "node_modules")
