"""Where intermediate tables go: the engine's own helper, under the shared folder."""

from docloom.functions.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
