"""Streams: memberships of a stream's points under a fitted model, and summaries that grow with the stream."""
