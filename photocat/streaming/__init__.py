"""Streaming twins of the batch operators."""

from photocat.streaming.arrivals import stream_publish_ingest, stream_publish_labels, stream_sync
from photocat.streaming.folds import stream_current_labels, stream_ingest_rate, stream_progress
from photocat.streaming.keyed import (
    latest_states,
    stream_batch_finished,
    stream_ingest_state,
    stream_tally,
    tally_now,
)

__all__ = [
    "stream_batch_finished",
    "stream_current_labels",
    "stream_ingest_rate",
    "stream_progress",
    "latest_states",
    "stream_ingest_state",
    "stream_publish_ingest",
    "stream_publish_labels",
    "stream_sync",
    "stream_tally",
    "tally_now",
]
