"""Configuration: defaults, TOML text in and out; unknown sections and keys are ignored."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from ..functions.rules import CONFIG_TEMPLATE, SIZE_BOUNDS


@dataclass
class General:
    db_path: str = "~/.paperloom/state"
    log_path: str = "~/.paperloom/logs/"
    log_level: str = "INFO"
    temp_dir: str = "~/.paperloom/tmp"


@dataclass
class Scanner:
    recursive: bool = True
    follow_symlinks: bool = False
    skip_hidden: bool = True
    min_file_size: int = SIZE_BOUNDS[0]
    max_file_size: int = SIZE_BOUNDS[1]
    file_patterns: list[str] = field(default_factory=lambda: ["*.pdf"])


@dataclass
class Extraction:
    max_pages_render: int = 2
    max_pages_text: int = 5
    text_quality_threshold: float = 0.3


@dataclass
class Vlm:
    """The model; runtime is a name of operators.backends.RUNTIMES."""

    enabled: bool = True
    runtime: str = "ollama"
    model: str = "minicpm-v"
    model_path: str = "~/.paperloom/models/"
    mmproj_path: str = ""
    hf_model_id: str = ""
    context_length: int = 4096
    max_tokens: int = 1024
    temperature: float = 0.1
    threads: int = 4
    gpu_layers: int = 0
    render_dpi: int = 200
    timeout_seconds: int = 120
    ollama_port: int = 11434
    llamacpp_port: int = 8080
    fallback_model: str = "llava"


@dataclass
class Ocr:
    enabled: bool = True
    engine: str = "tesseract"
    languages: list[str] = field(default_factory=lambda: ["eng"])
    dpi: int = 300
    preprocess: bool = True
    max_concurrent: int = 2


@dataclass
class Naming:
    default_template: str = CONFIG_TEMPLATE
    max_length: int = 80
    collision_strategy: str = "suffix"
    lowercase: bool = True
    separator: str = "_"
    strip_accents: bool = True


@dataclass
class Organizer:
    enabled: bool = True
    strategy: str = "type"
    base_dir: str = "./organized/"


@dataclass
class Performance:
    max_workers: int = 0
    batch_size: int = 100
    memory_limit_mb: int = 0
    io_priority: str = "normal"
    vlm_concurrent: int = 1
    fast_path_workers: int = 0


@dataclass
class Safety:
    dry_run: bool = True
    backup_originals: bool = False
    require_confirmation: bool = True


@dataclass
class Export:
    excel_columns: list[str] = field(default_factory=lambda: ["original_file", "original_location", "renamed_file", "moved_to_location", "document_type", "organization", "author", "date", "confidence", "extraction_method", "status"])


@dataclass
class Config:
    general: General = field(default_factory=General)
    scanner: Scanner = field(default_factory=Scanner)
    extraction: Extraction = field(default_factory=Extraction)
    vlm: Vlm = field(default_factory=Vlm)
    ocr: Ocr = field(default_factory=Ocr)
    naming: Naming = field(default_factory=Naming)
    organizer: Organizer = field(default_factory=Organizer)
    performance: Performance = field(default_factory=Performance)
    safety: Safety = field(default_factory=Safety)
    export: Export = field(default_factory=Export)

    def expanded(self) -> Config:
        """The same with the home folder in place of ~ in its paths."""
        for part, names in ((self.general, ("db_path", "log_path", "temp_dir")), (self.vlm, ("model_path",)), (self.organizer, ("base_dir",))):
            for name in names:
                setattr(part, name, str(Path(getattr(part, name)).expanduser()))
        return self


def load(path: str | Path | None) -> Config:
    """SRC-10."""
    config = Config()
    if path and Path(path).exists():
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        for section in fields(config):
            part, given = getattr(config, section.name), data.get(section.name)
            for f in fields(part) if isinstance(given, dict) else ():
                if f.name in given:
                    setattr(part, f.name, given[f.name])
    return config


def dump(config: Config) -> str:
    """SNK-7."""

    def text(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(text, v)) + "]"
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(v, str) else repr(v)

    return "\n".join("\n".join([f"[{s}]", *(f"{k} = {text(v)}" for k, v in part.items()), ""]) for s, part in asdict(config).items())


def save(config: Config, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(dump(config), encoding="utf-8")
