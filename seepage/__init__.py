"""seepage: cross-root secret provenance as Spark jobs.

Relations (all DataFrames):
  roots(path, branch, ...)           isolation domains
  files(path, content)               material under the roots
  processes(pid, ord, cwd)           actors
  writes(write_id, ts, path, content) file writes, batch or stream

Jobs:
  fingerprints(files, roots)         -> secret inventory            (operators.fingerprint)
  leak_events(writes, fps, roots)    -> attributed leak events      (operators.match)
  rollups over the event trail       -> map nodes/edges, ranking    (operators.rollups)
"""

from seepage.session import checkpoint_dir, get_session  # noqa: F401
