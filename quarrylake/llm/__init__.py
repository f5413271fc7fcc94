"""Training-data operators: near-duplicate detection, cleaning, scanning, packing.

Nothing outside this subpackage imports it; the entry module adds its queries only when
the import succeeds.
"""
