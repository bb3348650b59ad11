"""Streams: windowed means with late data, and exponentially weighted means by key."""

from sparkloom.streaming.windows import ewm_stream, resample_stream

__all__ = ["ewm_stream", "resample_stream"]
