"""siftwell: document retrieval, usage analytics and corpus preparation as PySpark DataFrame transforms."""
