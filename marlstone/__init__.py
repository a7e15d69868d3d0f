"""marlstone: document retrieval and question-answering analytics on Spark."""
