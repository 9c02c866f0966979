"""Settings from the environment and checked parameters of a run."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from datetime import date, timedelta

EARLIEST = date(1993, 1, 1)
MODES = {"annual": "10-K", "quarterly": "10-Q"}


def form_of(mode: str) -> str:
    """The form of a filing mode; an unknown mode is a ValueError."""
    try:
        return MODES[mode]
    except KeyError:
        raise ValueError(f"mode must be one of {', '.join(MODES)}: {mode!r}") from None


def _read_env_file(path: str) -> dict[str, str]:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as lines:
        pairs = (x.strip().split("=", 1) for x in lines if "=" in x and not x.lstrip().startswith("#"))
        return {k.strip().lower(): v.strip().strip("'\"") for k, v in pairs}


#: The user agent where none is set; good for trying things out only.
PLACEHOLDER = "ledgerloom user@example.com"


@dataclass(frozen=True)
class Settings:
    """Engine settings. :meth:`load` takes them from the environment, then an env file; other names there are ignored.

    ``store`` says whether points are kept as files only or also sent to the vector store at :attr:`store_location`.
    """

    email: str = PLACEHOLDER
    store: str = field(default="files", metadata={"among": ("files", "http")})
    store_url: str | None = None
    store_host: str = "localhost"
    store_port: int = field(default=6333, metadata={"range": (1, 65535)})
    store_timeout: int = field(default=60, metadata={"range": (1, None)})
    collection_prefix: str = "filings"
    distance: str = field(default="Cosine", metadata={"among": ("Cosine", "Euclid", "Dot")})
    vector_size: int | None = None
    embedding_model: str = "hashing"
    embedding_batch_size: int = field(default=32, metadata={"range": (1, None)})
    log_level: str = "INFO"
    log_format: str = field(default="simple", metadata={"among": ("simple", "detailed", "json")})
    environment: str = field(default="development", metadata={"among": ("development", "production", "test")})

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            low, high = f.metadata.get("range", (None, None))
            if (low is not None and value < low) or (high is not None and value > high):
                raise ValueError(f"{f.name} is out of range: {value}")
            if "among" in f.metadata and value not in f.metadata["among"]:
                raise ValueError(f"{f.name} must be one of {', '.join(f.metadata['among'])}: {value!r}")

    @classmethod
    def load(cls, env_file: str = ".env", **given) -> Settings:
        found = {**_read_env_file(env_file), **{k.lower(): v for k, v in os.environ.items()}}
        values = {}
        for f in fields(cls):
            if f.name in found:
                values[f.name] = int(found[f.name]) if "int" in str(f.type) else found[f.name]
        return cls(**{**values, **given})

    @property
    def is_production(self) -> bool:
        return self.environment == "production"

    @property
    def agent(self) -> str:
        """The user agent of requests; in production it must have been set."""
        if self.is_production and self.email == PLACEHOLDER:
            raise ValueError("set EMAIL: in production requests must name who makes them")
        return check_user_agent(self.email)

    @property
    def is_development(self) -> bool:
        return self.environment == "development"

    @property
    def store_location(self) -> str:
        """The URL if one is set, else host and port."""
        return self.store_url or f"http://{self.store_host}:{self.store_port}"


def check_user_agent(agent: str) -> str:
    """A user agent must not be empty, must name an e-mail address and have ten characters."""
    if not agent or "@" not in agent or len(agent) < 10:
        raise ValueError("the user agent needs a contact e-mail address and ten characters at least")
    return agent


@dataclass(frozen=True)
class RunConfig:
    """Checked parameters of a pipeline run."""

    keyword: str
    mode: str = "annual"
    start_date: date = field(default_factory=lambda: date.today() - timedelta(days=365))
    end_date: date = field(default_factory=date.today)
    limit: int | None = None
    max_new_tokens: int = 1024
    max_retries: int = 2
    batch_size: int = 16
    require_json: bool = True
    chunk_size: int = 2000
    chunk_overlap: int = 200
    collection_prefix: str | None = "filings"
    dry_run: bool = False
    template: str | None = None
    embedding_batch: int = 32
    distance: str = "Cosine"
    embedding_model: str = "hashing"
    vector_size: int | None = None
    store_location: str | None = None
    store_timeout: int = 60
    bare_references: bool = True

    def __post_init__(self) -> None:
        form_of(self.mode)
        if not self.keyword.strip():
            raise ValueError("keyword must not be blank")
        if self.start_date > date.today():
            raise ValueError("start_date lies in the future")
        if min(self.start_date, self.end_date) < EARLIEST:
            raise ValueError(f"dates must not be before {EARLIEST}")
        if self.start_date > self.end_date:
            raise ValueError("start_date must not be after end_date")
        if self.limit is not None and self.limit <= 0:
            raise ValueError("limit must be positive")
        for name in ("max_new_tokens", "max_retries", "batch_size", "chunk_size"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be from 0 to less than chunk_size")
