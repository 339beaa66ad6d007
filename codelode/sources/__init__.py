"""Sources of the engine: tables, repository trees, git logs, test reports."""
