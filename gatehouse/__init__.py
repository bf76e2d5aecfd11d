"""gatehouse: supplier-admission review as Spark jobs over tables."""
