"""Reading note stores, context documents, settings, status and log lines, and request logs."""
