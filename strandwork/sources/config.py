"""Project configuration: a file in a subset of YAML, merged over global settings and checked."""

from __future__ import annotations

from pathlib import Path

from ..functions.columns import one_of

#: Keys of a project's configuration, fixed values.
REQUIRED = ("project", "repo", "revisions", "rcs", "tagging")
OPTIONAL = ("description", "ml", "mailinglists", "sleepTime", "proxyHost", "proxyPort", "bugsProjectName", "productAsProject", "issueTrackerType", "issueTrackerURL", "issueTrackerProject", "issueTrackerUser", "issueTrackerPassword", "sloccount", "understand", "windowSize", "numWindows", "qualityType", "communicationType", "artifactType", "dependencyType")
TAGGING = ("tag", "committer2author", "proximity", "file", "feature", "feature_file")


class ConfigurationError(ValueError):
    """A configuration that lacks keys or contradicts itself."""


def parse(text: str) -> dict[str, object]:
    """``key: value`` lines; lists as [a, "b"]; integers and quoted strings; # starts a comment."""

    def scalar(x: str) -> object:
        x = x.strip()
        if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'":
            return x[1:-1]
        return int(x) if x.lstrip("-").isdigit() else x

    out: dict[str, object] = {}
    pending = ""
    for raw in text.splitlines():
        line = (pending + " " + raw.split(" #")[0].strip()).strip() if pending else raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.count("[") > line.count("]"):
            pending = line
            continue
        pending = ""
        if ":" not in line:
            raise ConfigurationError(f"no key in {line!r}")
        key, _, value = line.partition(":")
        value = value.strip()
        out[key.strip()] = [scalar(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else scalar(value)
    return out


def load(project: str, general: str | None = None) -> dict[str, object]:
    """Settings of a project file over those of a general one, checked."""
    conf = parse(Path(general).read_text()) if general else {}
    conf |= parse(Path(project).read_text())
    return check(conf)


def check(conf: dict[str, object]) -> dict[str, object]:
    """The configuration if all required keys are there, kinds are known and candidates match revisions."""
    missing = [k for k in REQUIRED if k not in conf]
    if missing:
        raise ConfigurationError(f"required keys are missing: {', '.join(missing)}")
    one_of(str(conf["tagging"]), TAGGING)
    revisions, candidates = conf["revisions"], conf["rcs"]
    if not isinstance(revisions, list) or not isinstance(candidates, list):
        raise ConfigurationError("revisions and rcs are lists")
    if len(revisions) < 2 and "windowSize" not in conf:
        raise ConfigurationError("two revisions or a window size are needed")
    if candidates and len(candidates) != len(revisions):
        raise ConfigurationError("there must be as many candidates as revisions")
    return conf
