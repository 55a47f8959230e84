"""Small numpy helpers on batches of clips; used inside tasks and tested without Spark."""
