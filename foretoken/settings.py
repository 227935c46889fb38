"""Parameters shared by the corpus, catalogue and scan jobs."""

from __future__ import annotations

from dataclasses import dataclass

# The two reserved ids and their text, and the ids of single bytes after them.
TEXT_BOUNDARY_ID = 0
UNKNOWN_ID = 1
RESERVED_TOKENS = {TEXT_BOUNDARY_ID: "<|endoftext|>", UNKNOWN_ID: "<unk>"}
FIRST_BYTE_ID = 2
FIRST_TOKEN_ID = FIRST_BYTE_ID + 256

# Token ids are unsigned 16-bit numbers.
ID_SPAN = 1 << 16


@dataclass(frozen=True)
class Settings:
    """Defaults are the production values; tests and the driver use smaller rows."""

    row_length: int = 2048
    n_shards: int = 1650
    vocab_size: int = 50432
    # Parts of the source that are built: shards [begin, end), -1 for all; rows of a shard and
    # batches of rows, None for all; shards that one job builds, None for all at once.
    begin_shard: int = 0
    end_shard: int = -1
    n_samples_per_shard: int | None = None
    batches: int | None = None
    shards_per_job: int | None = None
    id_chunks: int = 64
    batch_size: int = 2**17
    scan_batch_size: int = 2**7
    seq_len: int = 4
    context_ids: int = 5
    min_fraction: float = 0.5
    min_trigram_count: int = 1000
    # Pseudo-count with which a long context falls back on its short context.
    backoff: float = 1.0

    def __post_init__(self) -> None:
        if not FIRST_TOKEN_ID < self.vocab_size <= ID_SPAN:
            raise ValueError(f"vocab_size must lie in {FIRST_TOKEN_ID + 1}..{ID_SPAN}")
        if not 0 < self.row_length <= 1 << 16:
            raise ValueError("row_length must lie in 1..65536")
        if not 0 < self.n_shards <= 1 << 15:
            raise ValueError("n_shards must lie in 1..32768")
