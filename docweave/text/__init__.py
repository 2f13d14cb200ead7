"""Pure text scanners, used inside Arrow-batched functions. Offsets are code points; spans are half-open."""
