"""Memory of Python workers."""


def give_back() -> None:
    """Free memory goes back to the system: Python workers live on from task to task and from stage to stage."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
