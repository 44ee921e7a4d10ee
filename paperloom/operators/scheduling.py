"""Pure helpers of the driver: batch sizes, hardware, memory, drives."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass


@dataclass(frozen=True)
class BatchConfig:
    workers: int
    batch_size: int
    memory_mb: int


def batch_config(cores: int, ram_gb: float, total: int, *, max_workers: int = 0, workers: int = 0, batch: int = 32, memory_mb: int = 0, model: bool = False) -> BatchConfig:
    """SCH-1."""
    kept = int(model)
    n = workers or (max_workers - kept if max_workers else cores - 1 - kept)
    return BatchConfig(max(1, n), min(batch, total), memory_mb or int(ram_gb * 1024 * 0.7))


def recommended_model(ram_gb: float) -> str:
    """SCH-4."""
    return "large" if ram_gb >= 10 else "medium" if ram_gb >= 6 else "small" if ram_gb >= 4 else "none"


def system_profile(path: str = ".") -> dict:
    pages, size = os.sysconf("SC_PHYS_PAGES"), os.sysconf("SC_PAGE_SIZE")
    return {"cores": os.cpu_count() or 1, "ram_gb": pages * size / 2**30, "free_gb": shutil.disk_usage(path).free / 2**30}


def memory_ok(limit_mb: int) -> bool:
    """SCH-2: whether this process stays under a limit."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20 < limit_mb


def drive_workers(kind: str, default: int) -> int:
    """SCH-2: workers by kind of drive."""
    return {"ssd": default, "hdd": min(default, 2), "network": min(default, 2), "usb": 1}.get(kind, default)
