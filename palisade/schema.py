"""Relations as Spark DDL, and the small fixed dimensions that the operators use."""

from __future__ import annotations

DEPENDENCY = "name string, version string, ecosystem string, is_dev boolean, is_direct boolean, is_pinned boolean, is_range boolean, integrity string, brew_type string, source_file string, ord bigint"
ADVISORY_INDEX = "ecosystem string, name string, version string, id string"
ADVISORY = (
    "id string, summary string, aliases array<string>, severity array<struct<type: string, score: string>>, "
    "affected array<struct<package: struct<name: string>, ranges: array<struct<events: array<struct<fixed: string>>>>, ecosystem_specific: struct<severity: string>>>, "
    "database_specific struct<severity: string>, references array<struct<url: string>>, modified string, published string"
)
VULNERABILITY = "id string, display_id string, aliases array<string>, summary string, severity string, package string, version string, ecosystem string, fixed string, url string, references array<string>, details_missing boolean"
PACKAGE_VERSION = "name string, version string, published_at timestamp_ntz, publisher string, scripts map<string,string>, dependencies map<string,string>"
PACKAGE = "name string, latest_tag string, created_at timestamp_ntz, maintainers array<string>, repository string, license string"
#: Tables of cached answers, and the columns that tell their rows apart.
CACHES = {
    "advisories": ("ecosystem string, name string, version string, vulns string, fetched_at timestamp_ntz", ["ecosystem", "name", "version"]),
    "metadata": ("ecosystem string, name string, data string, fetched_at timestamp_ntz", ["ecosystem", "name"]),
    "signals": ("ecosystem string, name string, version string, data string, analyzed_at timestamp_ntz", ["ecosystem", "name", "version"]),
}
SIGNAL = "name string, version string, signal string, severity string, description string, evidence string, layer int, known_good boolean"

#: Severity, order, weight.
SEVERITIES = [("CRITICAL", 4, 10), ("HIGH", 3, 5), ("MODERATE", 2, 2), ("LOW", 1, 1)]
#: Other names of severities.
SYNONYMS = {"MEDIUM": "MODERATE", "IMPORTANT": "HIGH", "SEVERE": "CRITICAL"}
#: Ecosystem, its name in the advisory data, lockfiles, manifests.
ECOSYSTEMS = [
    ("npm", "npm", ["package-lock.json", "pnpm-lock.yaml", "yarn.lock"], ["package.json"]),
    ("pypi", "PyPI", ["Pipfile.lock", "poetry.lock"], ["requirements.txt", "pyproject.toml"]),
    ("cargo", "crates.io", ["Cargo.lock"], ["Cargo.toml"]),
    ("go", "Go", ["go.sum"], ["go.mod"]),
    ("ruby", "RubyGems", ["Gemfile.lock"], ["Gemfile"]),
    ("php", "Packagist", ["composer.lock"], ["composer.json"]),
    ("nuget", "NuGet", ["packages.lock.json"], ["*.csproj"]),
    ("java", "Maven", ["gradle.lockfile"], ["pom.xml"]),
    ("brew", None, ["Brewfile.lock.json"], ["Brewfile"]),
]
#: Npm hooks that run on installation.
LIFECYCLE_HOOKS = ["preinstall", "install", "postinstall", "prepare", "prepublish", "prepublishOnly", "prepack", "postpack", "dependencies"]
#: Capabilities that count as dangerous.
DANGEROUS = ["code_execution", "process_spawn", "network", "system_write", "credential_access", "self_deletion", "payload_decode"]
#: Environment keys that hold credentials.
SENSITIVE_ENV_KEYS = [
    "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "AWS_SESSION_TOKEN",
    "GITHUB_TOKEN", "GH_TOKEN", "NPM_TOKEN", "NODE_AUTH_TOKEN",
    "DATABASE_URL", "DB_PASSWORD", "PRIVATE_KEY", "SECRET_KEY",
    "API_KEY", "API_SECRET", "STRIPE_SECRET_KEY", "JWT_SECRET",
    "SSH_PRIVATE_KEY", "ENCRYPTION_KEY", "MASTER_KEY",
    "KUBE_TOKEN", "KUBERNETES_TOKEN", "DOCKER_PASSWORD",
    "SLACK_TOKEN", "DISCORD_TOKEN", "TELEGRAM_TOKEN",
]
#: Signals that configuration can't switch off.
PROTECTED_SIGNALS = ["KNOWN_COMPROMISED", "PHANTOM_DEPENDENCY", "CIRCULAR_STAGING", "CAPABILITY_ESCALATION"]
#: Hosts from which archives may come.
ARCHIVE_HOSTS = ["registry.npmjs.org", "files.pythonhosted.org"]

EXIT_OK, EXIT_FOUND, EXIT_ERROR = 0, 1, 2
HOUR_MS, DAY_MS = 3_600_000, 86_400_000
ADVISORY_TTL_MS, METADATA_TTL_MS = HOUR_MS, DAY_MS
MOST_ADVISORY_TTL_MS, MOST_METADATA_TTL_MS = 7 * DAY_MS, 30 * DAY_MS
