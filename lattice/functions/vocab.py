"""Names the engine knows.

Fixed values: which extensions, directories and file names have a meaning is part of the results.
"""

IGNORED_DIRS = (
    ".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", ".pnpm-store", ".yarn", "bower_components", "dist", "build", "out", "target",
    ".next", ".next-dev", ".nuxt", ".output", ".svelte-kit", ".turbo", ".vercel", ".vite", ".cache", ".parcel-cache", "playwright-report",
    "test-results", "storybook-static", ".pytest_cache", "__pycache__", ".mypy_cache", ".ruff_cache", "vendor", "tmp", "temp", "logs",
)
BINARY_EXTS = (
    "png", "jpg", "jpeg", "gif", "webp", "ico", "pdf", "zip", "gz", "tgz", "rar", "7z", "exe", "dll", "so", "dylib", "wasm", "woff", "woff2",
    "ttf", "otf", "mp3", "mp4", "mov", "avi", "mkv", "bin", "class", "jar",
)
ASSET_EXTS = ("png", "jpg", "jpeg", "gif", "webp", "ico", "svg", "woff", "woff2", "ttf", "otf", "mp3", "mp4", "mov", "webm", "wav")
SOURCE_EXTS = (
    "ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "rs", "go", "java", "kt", "kts", "swift", "c", "cc", "cpp", "h", "hpp", "cs",
    "rb", "php", "vue", "svelte", "ex", "exs", "dart", "lua", "scala", "clj", "cljs", "erl", "hrl", "fs", "fsx",
)
SCRIPT_EXTS = ("sh", "bash", "zsh")
SNAPSHOT_EXTS = ("snap", "snapshot")
TEXT_EXTS = (
    "json", "toml", "yaml", "yml", "md", "txt", "sql", "prisma", "graphql", "gql", "proto", "avsc", "lock", "tf", "hcl", "css", "scss", "sass",
    "less", "svg", "snap", "snapshot", "sh", "bash", "zsh",
)
DOMAIN_DIRS = ("domains", "packages", "apps", "services", "libs", "crates", "modules", "cmd", "components")
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "go.sum", "poetry.lock", "uv.lock", "package.resolved")
MANIFESTS = ("package.json", "cargo.toml", "go.mod", "pyproject.toml", "package.swift")
STRUCTURAL_NAMES = (*MANIFESTS, "go.work", "agents.md", "readme.md", "makefile", "gnumakefile", "justfile", "dockerfile", "jenkinsfile")
PUBLIC_BOUNDARY_NAMES = (
    "index.ts", "index.tsx", "index.js", "index.jsx", "mod.rs", "lib.rs", "main.rs", "main.go", "__init__.py", "api.ts", "routes.ts", *MANIFESTS,
)
#: Role, and the path tokens (or their plurals) that give it.
TOKEN_ROLES = {
    "state_model": ("state", "store", "model", "entity", "timeline", "reducer", "machine", "registry", "repository", "project", "aggregate"),
    "runtime_state": ("session", "cursor", "clock", "controller", "manager"),
    "adapter": ("adapter", "gateway", "client", "provider", "port", "driver"),
    "parser": ("parser", "parse", "loader", "reader", "decoder"),
    "persistence": ("save", "load", "reopen", "persist", "persistence", "storage"),
    "repo_discovery": ("root", "inventory", "files", "discover", "discovery"),
    "cache": ("cache", "fingerprint"),
    "cli_surface": ("cli", "command"),
}
#: Roles of those above that only sources can have.
SOURCE_TOKEN_ROLES = ("state_model", "runtime_state")
#: Roles that a test loses.
NOT_OF_TESTS = (
    "state_model", "runtime_state", "public_boundary", "adapter", "schema_contract", "parser", "renderer_ui", "persistence", "repo_discovery",
    "cache", "cli_surface", "build_ci", "proof_runner", "script", "entrypoint", "runtime_surface", "public_api", "internal_api", "doctor",
)
#: The first of these roles names a file's kind.
KIND_ROLES = (
    "snapshot", "golden", "asset", "e2e_test", "test_support", "test", "receipt", "witness", "proof_runner", "script", "owner_doc", "migration",
    "manifest", "schema_contract", "schema", "public_boundary", "public_api", "internal_api", "env_config", "runtime_config", "lockfile", "docs",
    "doctor", "runtime_state", "build_ci", "deploy", "entrypoint", "runtime_surface", "adapter", "parser", "renderer_ui", "persistence",
    "repo_discovery", "cache", "semantic_anchor", "agent_bootstrap", "fixture", "example", "generated",
)
LANGUAGES = {
    "javascript/typescript": ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "vue", "svelte"),
    "python": ("py",),
    "rust": ("rs",),
    "go": ("go",),
    "swift": ("swift",),
    "config": ("json", "toml", "yaml", "yml", "tf", "hcl"),
    "schema": ("prisma", "graphql", "gql", "proto", "avsc"),
    "sql": ("sql",),
    "style": ("css", "scss", "sass", "less"),
    "shell": SCRIPT_EXTS,
    "asset": ASSET_EXTS,
    "snapshot": SNAPSHOT_EXTS,
    "markdown": ("md",),
}
#: Kinds of languages without a role.
LANGUAGE_KINDS = {
    "style": "style", "asset": "asset", "snapshot": "snapshot", "config": "config", "env": "env_config", "schema": "schema_contract",
    "lockfile": "lockfile", "markdown": "docs", "shell": "script",
}
